"""Packing by power-of-two decomposition: a document of L ids becomes L // 1024 pieces of 1024 ids and one
piece for each binary digit of the rest. Each piece is a sequence of its own, so no sequence crosses
documents and none is padded. Pieces of equal length form a bucket: rows carry it, come out bucket by bucket
within a batch, and sequence ids sort by it; write_buckets puts each bucket into a folder of its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Encoder, slices

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, bucket int"
#: Bits of a sequence id: 4 for the length's power, 24 for the partition, 35 for the count in it. Beyond them is an error.
_PART, _POWER = 35, 59
_LONGEST = 1 << 15


def pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) pieces of n ids: whole ones of the longest length, then falling powers of two."""
    out = [(a, longest) for a in range(0, n - longest + 1, longest)]
    at = len(out) * longest
    while at < n:
        size = 1 << ((n - at).bit_length() - 1)
        out.append((at, size))
        at += size
    return out


def pack_documents(docs: DataFrame, tokenizer: str, longest: int = 1024, end_id: int = 0) -> DataFrame:
    """One row for each piece, ids as little-endian unsigned 32-bit binary.

    One pass without a shuffle: documents of any size are cut where they lie, and a sequence id is made of
    the length's power of two, the partition and a running count, which a repeated task makes again alike.
    bucket is the length's power of two. longest must be a power of two, 2^15 at most. Null or empty text: one piece that holds the end id. Null doc_ids and
    repeated rows are packed as they come; an empty table gives no rows; other columns are not read.
    """
    if longest < 1 or longest & (longest - 1) or longest > _LONGEST:
        raise ValueError("longest must be a power of two, 2^15 at most")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.at(tokenizer), TaskContext.get().partitionId()
        end, count = np.array([end_id], "<u4").tobytes(), [0] * longest.bit_length()
        if part >> (_POWER - _PART):
            raise OverflowError("more partitions than a sequence id holds")
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in slices(texts):
                buckets: list[list[tuple]] = [[] for _ in count]
                for doc, data in zip(ids[a:b], encoder.encode(texts[a:b])):
                    data += end
                    n = len(data) // 4
                    for start, size in pieces(n, longest):
                        power = size.bit_length() - 1
                        if count[power] >> _PART:
                            raise OverflowError("more pieces of a length than a sequence id holds")
                        buckets[power].append((doc, start, size, data[4 * start : 4 * (start + size)], n, power << _POWER | part << _PART | count[power], 0, power))
                        count[power] += 1
                rows = [row for bucket in reversed(buckets) for row in bucket]
                kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3 + [pa.int32()]
                columns = zip(*rows) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "bucket"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, SCHEMA)


def packed_digest(packed: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def write_buckets(packed: DataFrame, path: str) -> None:
    """Parquet with a folder for each bucket, so that a reader takes sequences of one length only."""
    packed.write.partitionBy("bucket").parquet(path)
