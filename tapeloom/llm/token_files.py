"""Token files in patched frame-of-reference blocks.

A segment holds whole documents in ascending doc_id order, about a million ids. Its ids are cut into blocks
of 128; a block stores its minimum, the differences packed at a width that a percentile of them fits,
and an exception list of positions and full differences for the rest. A table of block starts gives random
access. Segments are binary values that Spark writes (Parquet as container), so the commit protocol
leaves out files of lost or repeated tasks on any file system.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tokens import Encoder, slices

BLOCK, SEGMENT_IDS, PERCENTILE = 128, 1 << 20, 0.98
MAGIC = b"PFR1"
SEGMENT = "part int, segment int, part_start long, n_docs int, n_tokens long, payload binary"
READ = "part int, segment int, part_start long, doc_id long, ids binary"


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.where(values > 0, np.floor(np.log2(np.maximum(values, 1))).astype(np.int64) + 1, 0)


def _to_bits(rows: np.ndarray, w: int) -> np.ndarray:
    """Values of w bits in big-endian bit order: eight of them take w bytes."""
    eight = rows.reshape(-1, 8)
    out = np.zeros((len(eight), w), np.uint8)
    for k in range(8):
        byte, bit = divmod(k * w, 8)
        span = (bit + w + 7) // 8
        v = eight[:, k].astype(np.uint64) << np.uint64(8 * span - bit - w)
        for j in range(span):
            out[:, byte + j] |= (v >> np.uint64(8 * (span - 1 - j))).astype(np.uint8)
    return out.reshape(len(rows), -1)


def _from_bits(data: np.ndarray, w: int) -> np.ndarray:
    eight = data.reshape(-1, w)
    out = np.empty((len(eight), 8), np.uint32)
    for k in range(8):
        byte, bit = divmod(k * w, 8)
        span = (bit + w + 7) // 8
        v = eight[:, byte].astype(np.uint32 if span <= 4 else np.uint64)
        for j in range(1, span):
            v = (v << v.dtype.type(8)) | eight[:, byte + j]
        out[:, k] = (v >> v.dtype.type(8 * span - bit - w)) & v.dtype.type((1 << w) - 1)
    return out.reshape(len(data), -1)


def pack_ids(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """Header (count, blocks, exceptions), minima, widths, exception counts, block starts, packed bits, exceptions."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    if n and n < len(padded):
        padded[n:] = ids[-1]
    rows = padded.reshape(blocks, BLOCK)
    low = rows.min(axis=1) if blocks else np.zeros(0, np.uint32)
    diff = rows - low[:, None]
    k = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    width = _bits(np.partition(diff, k, axis=1)[:, k]) if blocks else np.zeros(0, np.int64)
    over = diff.astype(np.uint64) >= (np.uint64(1) << width.astype(np.uint64))[:, None]
    starts = np.concatenate([[0], np.cumsum(width * (BLOCK // 8))]).astype(np.uint32)
    packed = np.zeros(int(starts[-1]), np.uint8)
    kept = np.where(over, 0, diff)
    for w in np.unique(width):
        if w:
            at = np.flatnonzero(width == w)
            packed[starts[at][:, None] + np.arange(w * BLOCK // 8)] = _to_bits(kept[at], int(w))
    where = np.nonzero(over)
    head = struct.pack("<4sQII", MAGIC, n, blocks, len(where[0]))
    return b"".join([head, low.astype("<u4").tobytes(), width.astype(np.uint8).tobytes(), over.sum(axis=1).astype(np.uint8).tobytes(), starts.astype("<u4").tobytes(), packed.tobytes(), where[1].astype(np.uint8).tobytes(), diff[where].astype("<u4").tobytes()])


def unpack_ids(data: bytes) -> np.ndarray:
    """The ids of pack_ids."""
    magic, n, blocks, outliers = struct.unpack_from("<4sQII", data)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    at = struct.calcsize("<4sQII")

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    low, width, extra, starts = take("<u4", blocks), take("u1", blocks), take("u1", blocks), take("<u4", blocks + 1)
    packed, place, value = take("u1", int(starts[-1])), take("u1", outliers), take("<u4", outliers)
    diff = np.zeros((blocks, BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            diff[rows] = _from_bits(packed[starts[rows][:, None] + np.arange(int(w) * BLOCK // 8)], int(w))
    diff[np.repeat(np.arange(blocks), extra), place] = value
    return (diff + low[:, None]).ravel()[:n]


def read_ids(data: memoryview | bytes, start: int, count: int) -> np.ndarray:
    """Ids start to start + count of pack_ids' bytes: only the blocks that hold them are unpacked, found by their starts."""
    magic, n, blocks, outliers = struct.unpack_from("<4sQII", data)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    start, end = max(0, start), min(n, start + count)
    if start >= end:
        return np.zeros(0, np.uint32)
    first, last = start // BLOCK, -(-end // BLOCK)
    at = struct.calcsize("<4sQII")
    low = np.frombuffer(data, "<u4", last - first, at + 4 * first)
    width = np.frombuffer(data, "u1", last - first, at + 4 * blocks + first)
    extra = np.frombuffer(data, "u1", last, at + 5 * blocks).astype(np.int64)
    starts = np.frombuffer(data, "<u4", blocks + 1, at + 6 * blocks)
    bits = at + 6 * blocks + 4 * (blocks + 1)
    skip, own = int(extra[:first].sum()), extra[first:]
    place = np.frombuffer(data, "u1", int(own.sum()), bits + int(starts[-1]) + skip)
    value = np.frombuffer(data, "<u4", int(own.sum()), bits + int(starts[-1]) + outliers + 4 * skip)
    diff = np.zeros((last - first, BLOCK), np.uint32)
    for k, w in enumerate(width.tolist()):
        if w:
            diff[k] = _from_bits(np.frombuffer(data, "u1", w * BLOCK // 8, bits + int(starts[first + k]))[None, :], w)[0]
    diff[np.repeat(np.arange(last - first), own), place] = value
    return (diff + low[:, None]).ravel()[start - first * BLOCK : end - first * BLOCK]


def _segment(ids: list[int | None], streams: list[bytes]) -> bytes:
    """Document table (ids, null flags, lengths), then the packed ids."""
    lengths = np.array([len(s) // 4 for s in streams], "<u4")
    table = np.array([0 if i is None else i for i in ids], "<i8").tobytes() + np.array([i is None for i in ids], np.uint8).tobytes() + lengths.tobytes()
    return struct.pack("<I", len(ids)) + table + pack_ids(np.frombuffer(b"".join(streams), "<u4"))


def _open_segment(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    (n,) = struct.unpack_from("<I", data)
    ids, null, lengths = np.frombuffer(data, "<i8", n, 4), np.frombuffer(data, "u1", n, 4 + 8 * n), np.frombuffer(data, "<u4", n, 4 + 9 * n)
    return [None if z else int(i) for i, z in zip(ids, null)], lengths.astype(np.int64), unpack_ids(data[4 + 13 * n :])


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1) -> None:
    """Encodes every document, appends end_id and writes segments in ascending doc_id order (null first).

    One range-partitioned sort by doc_id; a worker holds one segment. Null or empty text: only the end id.
    Rows of equal doc_id follow each other, by text; an empty table gives no segment; other columns are not
    read. A very long text makes a segment of its own.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.at(tokenizer), TaskContext.get().partitionId()
        end, state = np.array([end_id], "<u4").tobytes(), {"ids": [], "streams": [], "n": 0, "segment": 0, "before": 0}

        def flush() -> pa.RecordBatch:
            row = [[part], [state["segment"]], [state["before"]], [len(state["ids"])], [state["n"]], [_segment(state["ids"], state["streams"])]]
            state.update(ids=[], streams=[], n=0, segment=state["segment"] + 1, before=state["before"] + state["n"])
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary()])], ["part", "segment", "part_start", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in slices(texts):
                for doc, data in zip(ids[a:b], encoder.encode(texts[a:b])):
                    state["ids"].append(doc)
                    state["streams"].append(data + end)
                    state["n"] += len(data) // 4 + 1
                    if state["n"] >= SEGMENT_IDS:
                        yield flush()
        if state["ids"]:
            yield flush()

    ordered = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(encode, SEGMENT).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document, or with digest ids_crc32 in place of ids. start counts
    all ids before the document; the offsets of partitions are one row each."""
    files = spark.read.schema(SEGMENT).parquet(path)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, before, payload in zip(batch.column("part").to_pylist(), batch.column("part_start").to_pylist(), batch.column("payload")):
                docs, lengths, ids = _open_segment(payload.as_py())
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                parts = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
                last = pa.array([zlib.crc32(p) for p in parts], pa.int64()) if digest else pa.array([bytes(p) for p in parts], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(before + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), last], ["part", "doc_id", "local", "n_tokens", name])

    name = "ids_crc32" if digest else "ids"
    rows = files.select("part", "part_start", "payload").mapInArrow(decode, f"part int, doc_id long, local long, n_tokens long, {name} {'long' if digest else 'binary'}")
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    return rows.join(base, "part").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", name)


def read_documents(spark: SparkSession, path: str, wanted: DataFrame, start: int = 0, count: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids) of the documents whose doc_id is in wanted, or of ids start to start + count of each.

    The segments' document tables say which segment holds a document; in it, the table and the block starts lead
    to the blocks to unpack. Documents that were written twice come twice; a
    null doc_id finds nothing.
    """
    files = spark.read.schema(SEGMENT).parquet(path)

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], []]
            for part, segment, payload in zip(batch.column("part").to_pylist(), batch.column("segment").to_pylist(), batch.column("payload")):
                data = payload.as_buffer()
                (n,) = struct.unpack_from("<I", data)
                ids, null = np.frombuffer(data, "<i8", n, 4), np.frombuffer(data, "u1", n, 4 + 8 * n)
                for doc in np.unique(ids[null == 0]).tolist():
                    for row, x in zip(rows, (part, segment, doc)):
                        row.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, (pa.int32(), pa.int32(), pa.int64()))], ["part", "segment", "doc_id"])

    places = files.select("part", "segment", "payload").mapInArrow(ends, "part int, segment int, doc_id long")
    asked = places.join(wanted.select("doc_id").distinct(), "doc_id").groupBy("part", "segment").agg(F.collect_list("doc_id").alias("asked"))

    def seek(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, sizes, found = [], [], []
            for payload, ask in zip(batch.column("payload"), batch.column("asked").to_pylist()):
                data = payload.as_buffer()
                (n,) = struct.unpack_from("<I", data)
                ids, null, lengths = np.frombuffer(data, "<i8", n, 4), np.frombuffer(data, "u1", n, 4 + 8 * n), np.frombuffer(data, "<u4", n, 4 + 9 * n).astype(np.int64)
                before = np.cumsum(lengths) - lengths
                body = memoryview(data)[4 + 13 * n :]
                for k in np.flatnonzero(np.isin(ids, ask) & (null == 0)).tolist():
                    size = int(lengths[k])
                    most = max(0, size - start) if count is None else min(count, max(0, size - start))
                    docs.append(int(ids[k]))
                    sizes.append(size)
                    found.append(read_ids(body, int(before[k]) + start, most).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return files.join(asked, ["part", "segment"]).select("payload", "asked").mapInArrow(seek, "doc_id long, n_tokens long, ids binary")
