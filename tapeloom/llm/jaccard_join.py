"""Exact Jaccard self-join on word shingles, down to the groups of linked documents.

Equal sets are one node. A pair of similar sets shares a shingle among the first quarter of both in any
common order, so rows (shingle, node) of those prefixes bring candidates together; the place of a shingle
in a set also tells how large a partner can be. Very frequent shingles come last in the order: a bounded
hint that changes the work but never the result.

Two rounds keep dense groups linear without losing a link:
1. Star: each node of a shingle's group against the group's first node. Copies in thousands link up here.
2. Tiles: groups whose nodes are not all linked to their first one are compared pairwise, large groups in
   blocks banded by size. Only pairs of different components go on.
In both rounds the bits in which two parity bitmaps differ bound the overlap from above before the exact
intersection of sorted arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, materialize
from .shingles import set_hash, shingle_sets
from .tokens import slices

#: Shingles in so many distinct sets of one batch are reported; of those in so many overall, the most frequent come last.
LOCAL_HOT, HOT, HOT_MOST = 6, 48, 1 << 16
BITS = 512
TILE = 4096
#: Partners of a text that are compared in one task.
SALT_ROWS = 4096
#: Positions of the bounded filter that keeps unneeded texts from being read again.
FILTER = 1 << 20


def needed(a, b):
    """Least overlap of sets of sizes a and b that link: 100 * i >= 75 * (a + b - i)."""
    return -(-(3 * (a + b)) // 7)


def _bitmaps(s: np.ndarray) -> tuple[bytes, bytes]:
    """Parity of the number of shingles that fall on each bit: of BITS bits, and of at least two a shingle. As the
    sizes are powers of two, halves laid over each other by exclusive or give the next smaller one."""
    size = max(BITS, 1 << (2 * len(s) - 1).bit_length())
    parity = np.bincount((s >> np.uint64(20)).astype(np.int64) & (size - 1), minlength=size) & 1
    wide = np.packbits(parity.astype(np.uint8)).view(np.uint64)
    return _folded(wide, BITS // 64).tobytes(), wide.tobytes()


def _folded(bits: np.ndarray, words: int) -> np.ndarray:
    return np.bitwise_xor.reduce(bits.reshape(-1, words), axis=0) if len(bits) > words else bits


def _texts(batches: Iterator[pa.RecordBatch]):
    """(doc_ids, sets) of bounded slices."""
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        for a, b in slices(texts):
            yield ids[a:b], shingle_sets(texts[a:b])


def _describe(docs: DataFrame) -> DataFrame:
    """One pass: (doc_id, node, n, bits, wide) of every document, and (shingle, seen) of locally frequent ones."""

    def describe(batches):
        names = ["doc_id", "node", "n", "bits", "wide", "shingle", "seen"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        known, held, count = set(), [], 0

        def hot():
            values, seen = np.unique(np.concatenate(held), return_counts=True)
            keep = seen >= LOCAL_HOT
            k = int(keep.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64())] * 3 + [pa.nulls(k, pa.binary())] * 2 + [pa.array(values[keep].view(np.int64)), pa.array(seen[keep].astype(np.int64))], names)

        for ids, sets in _texts(batches):
            nodes = [set_hash(s) for s in sets]
            for h, s in zip(nodes, sets):
                if len(s) and h not in known:
                    known.add(h)
                    held.append(s)
                    count += len(s)
            maps = [_bitmaps(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([ids, nodes, [len(s) for s in sets], [m[0] for m in maps], [m[1] for m in maps]], kinds)] + [pa.nulls(len(ids), pa.int64())] * 2, names)
            if count > 4_000_000:
                yield hot()
                known, held, count = set(), [], 0
        if held:
            yield hot()

    return materialize(docs.mapInArrow(describe, "doc_id long, node long, n long, bits binary, wide binary, shingle long, seen long"), "sets")


def _prefix_rows(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """(shingle, node, n, most): the prefix of each set in the order (frequent, hash). A partner that meets the set
    first at place i has at most (4 n - 7 i) / 3 shingles, else too few can be common."""
    held = docs.sparkSession.sparkContext.broadcast(hot)

    def prefixes(batches):
        known: set[int] = set()
        frequent = held.value
        for _, sets in _texts(batches):
            tokens, nodes, sizes, mosts = [], [], [], []
            for s in sets:
                if not len(s) or (h := set_hash(s)) in known:
                    continue
                known.add(h)
                keep = len(s) - -(-3 * len(s) // 4) + 1
                if len(frequent):
                    at = np.searchsorted(frequent, s)
                    late = frequent[np.minimum(at, len(frequent) - 1)] == s
                    p = s[~late][:keep]
                    if len(p) < keep:
                        p = np.concatenate([p, s[late][: keep - len(p)]])
                else:
                    p = s[:keep]
                tokens.append(p)
                nodes.append(np.full(keep, h, np.int64))
                sizes.append(np.full(keep, len(s), np.int32))
                mosts.append(((4 * len(s) - 7 * np.arange(keep)) // 3).astype(np.int32))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(mosts))], ["shingle", "node", "n", "most"])

    return docs.mapInArrow(prefixes, "shingle long, node long, n int, most int")


def _stars(rows: DataFrame) -> DataFrame:
    """(shingle, node, n, most, lead, lead_n, lead_most): each further node of a shingle's group beside its first,
    which is the one that admits the largest partners. The sorted rows are streamed, so no group is held."""

    def stream(batches):
        last = None  # shingle, node and the leader's columns
        for t in batches:
            if not len(t):
                continue
            shingle, node, n, most = (t.column(c).to_numpy() for c in ("shingle", "node", "n", "most"))
            new = np.concatenate([[last is None or shingle[0] != last[0]], shingle[1:] != shingle[:-1]])
            again = ~new & (node == np.concatenate([[last[1] if last else 0], node[:-1]]))
            lead = np.maximum.accumulate(np.where(new, np.arange(len(node)), -1))
            cols = [np.where(lead >= 0, c[np.maximum(lead, 0)], old) for c, old in zip((node, n, most), last[2:] if last else (0, 0, 0))]
            last = (shingle[-1], node[-1], *(c[-1] for c in cols))
            keep = ~new & ~again
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c[keep], k) for c, k in zip((shingle, node, n, most, *cols), kinds)], ["shingle", "node", "n", "most", "lead", "lead_n", "lead_most"])

    ordered = rows.repartition("shingle").sortWithinPartitions("shingle", F.col("most").desc(), "node")
    return materialize(ordered.mapInArrow(stream, "shingle long, node long, n int, most int, lead long, lead_n int, lead_most int"), "stars")


def _bits_apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64)


def _bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that the bitmap bound lets pass. nodes: (node, n, wide)."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("wide").alias("xa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("xb"))

    def bound(batches):
        for t in batches:
            na, nb = (t.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            differ = np.zeros(len(t), np.int64)
            for k, (x, y) in enumerate(zip(t.column("xa"), t.column("xb"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                words = min(len(x), len(y))
                differ[k] = _bits_apart(_folded(x, words), _folded(y, words))
            yield t.select(["a", "b"]).filter(pa.array((na + nb - differ) // 2 >= needed(na, nb)))

    return materialize(pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "xa", "xb").mapInArrow(bound, "a long, b long"), "near")


def _linked(near: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that link, by the exact intersection of sorted arrays.

    Texts travel compressed and become sets where they meet: those of all a go to their b, and those of b
    to each of its salts, so a text with very many partners is spread over tasks. A bounded table of hashed
    ids keeps most other texts out before the joins do. nodes: (node, n, bits, wide, doc_id).
    """
    first = nodes.select("node", "doc_id")
    pairs = near.join(first.withColumnRenamed("node", "a").withColumnRenamed("doc_id", "da"), "a").join(first.withColumnRenamed("node", "b").withColumnRenamed("doc_id", "db"), "b")
    pairs = materialize(pairs, "pairs")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER)).cast("int")
    flags = np.zeros(FILTER, bool)
    for chunk in pairs.select(F.explode(F.array(place("da"), place("db"))).alias("p")).distinct().toArrow().column("p").chunks:
        flags[chunk.to_numpy()] = True
    held = docs.sparkSession.sparkContext.broadcast(np.packbits(flags))

    def let_in(batches):
        on = np.unpackbits(held.value).astype(bool)
        pack = zstandard.ZstdCompressor(3).compress
        for t in batches:
            t = t.filter(pa.array(on[t.column("p").to_numpy()]))
            yield pa.RecordBatch.from_arrays([t.column("doc_id"), pa.array([pack(x.encode("utf-8", "surrogatepass")) for x in t.column("text").to_pylist()], pa.binary())], ["doc_id", "z"])

    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text", place("doc_id").alias("p")).mapInArrow(let_in, "doc_id long, z binary")
    salts = pairs.groupBy("b").agg(F.first("db").alias("db"), F.ceil(F.count(F.lit(1)) / F.lit(SALT_ROWS)).cast("int").alias("salts"))
    salted = pairs.join(salts.select("b", "salts"), "b").withColumn("salt", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int"))
    # shuffled at any size: a plan that broadcasts while pairs are few would move more only as they grow
    members = texts.join(salted.hint("shuffle_hash"), texts["doc_id"] == salted["da"]).select("b", "salt", "a", "z")
    heads = texts.join(salts.hint("shuffle_hash"), texts["doc_id"] == salts["db"]).select("b", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("a"), "z")
    together = heads.union(members).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())

    def exact(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        head, own = None, np.zeros(0, np.uint64)
        for t in batches:
            found_a, found_b = [], []
            for b, a, z in zip(t.column("b").to_pylist(), t.column("a").to_pylist(), t.column("z")):
                s = shingle_sets([unpack(z.as_py()).decode("utf-8", "surrogatepass")])[0]
                h = set_hash(s)
                if a is None:
                    if h == b:
                        head, own = b, s
                elif h == a and head == b:  # else another text of that doc_id
                    both = len(np.intersect1d(s, own, assume_unique=True))
                    if 100 * both >= 75 * (len(s) + len(own) - both):
                        found_a.append(a)
                        found_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    return materialize(together.mapInArrow(exact, "a long, b long").distinct(), "links")


def _tiles(rows: DataFrame) -> DataFrame:
    """rows with a tile. A group of at most TILE rows is one tile. A larger one is cut into bands of sizes 4/3
    apart and blocks of about TILE rows; a tile is a pair of blocks of one band or of neighbouring ones, and
    each row goes to the tiles of its block only."""
    counts = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("rows"))
    sized = rows.join(counts, "shingle")
    tile = lambda lo_band, i, up, j: F.struct(lo_band.cast("int").alias("band"), i.cast("int").alias("i"), up.cast("int").alias("up"), j.cast("int").alias("j"))
    zero, one = F.lit(0), F.lit(1)
    small = sized.where(F.col("rows") <= TILE).withColumn("tile", tile(zero, zero, zero, zero)).drop("rows")
    banded = sized.where(F.col("rows") > TILE).drop("rows").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(4 / 3))).cast("int"))
    blocks = banded.groupBy("shingle", "band").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("int").alias("blocks"))
    above = blocks.select("shingle", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    under = blocks.select("shingle", (F.col("band") + 1).alias("band"), F.col("blocks").alias("under"))
    around = blocks.join(above, ["shingle", "band"], "left").join(under, ["shingle", "band"], "left")
    placed = banded.join(around, ["shingle", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    span = lambda c: F.when(F.col(c) > 0, F.sequence(zero, F.col(c) - 1)).otherwise(F.array().cast("array<int>"))
    band, block = F.col("band"), F.col("block")
    same = F.transform(span("blocks"), lambda j: tile(band, F.least(block, j), zero, F.greatest(block, j)))
    up = F.transform(span("above"), lambda j: tile(band, block, one, j))
    down = F.transform(span("under"), lambda j: tile(band - 1, j, one, block))
    large = placed.withColumn("tile", F.explode(F.concat(same, up, down)))
    return small.unionByName(large.select(*small.columns))


def _tile_pairs(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) of different components that share a prefix shingle and pass the size and bitmap bounds.

    rows: (shingle, node, n, most, component).
    """
    full = _tiles(rows).join(nodes.select("node", "bits"), "node").select("shingle", "tile", "node", "n", "most", "component", "bits")
    ordered = full.repartition("shingle", "tile").sortWithinPartitions("shingle", "tile", "n").select("shingle", F.xxhash64("tile").alias("tile"), "node", "n", "most", "component", "bits")

    def pairs_of(node, n, most, part, bits, out: set):
        for i in range(len(node) - 1):
            to = int(np.searchsorted(n, most[i], "right"))
            if to <= i + 1:
                continue
            j = np.flatnonzero((part[i + 1 : to] != part[i]) & (most[i + 1 : to] >= n[i])) + i + 1
            if len(j):
                j = j[(n[j] + n[i] - _bits_apart(bits[j], bits[i])) // 2 >= needed(n[j], n[i])]
                out.update((min(node[i], x), max(node[i], x)) for x in node[j].tolist())

    def compare(batches):
        held: list = []

        def groups(whole: bool):
            t = pa.Table.from_batches(held)
            shingle, tile, node, n, most, part = (t.column(c).to_numpy().astype(np.int64) for c in ("shingle", "tile", "node", "n", "most", "component"))
            bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(len(node), BITS // 64)
            edge = np.concatenate([[0], np.flatnonzero((shingle[1:] != shingle[:-1]) | (tile[1:] != tile[:-1])) + 1, [len(node)]])
            if not whole:
                edge = edge[:-1]  # the last group may go on
            out: set = set()
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if b - a > 1 and (part[a:b] != part[a]).any():
                    pairs_of(node[a:b], n[a:b], most[a:b], part[a:b], bits[a:b], out)
            held[:] = t.slice(int(edge[-1])).to_batches() if not whole else []
            return pa.RecordBatch.from_arrays([pa.array([int(x[k]) for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

        for batch in batches:
            if len(batch):
                held.append(batch)
            if sum(map(len, held)) > 50_000:
                yield groups(False)
        if held:
            yield groups(True)

    return materialize(ordered.mapInArrow(compare, "a long, b long").distinct(), "tiles")


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document: component_id is the smallest doc_id reachable over
    links, its own included. Every link counts; copies are one node and pairs of them are not listed.

    Null, empty or wordless texts have no shingles and are linked with nothing. A row without doc_id gets no
    component and gives none. Repeated rows stay; rows of one doc_id are one document for linking. An
    empty table gives no rows. Other columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    described = _describe(docs)
    members = described.where("n is not null").select("doc_id", "node", "n")
    known = described.where("n > 0 and doc_id is not null")
    nodes = materialize(known.groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("wide").alias("wide"), F.min("doc_id").alias("doc_id")), "nodes")
    frequent = described.where("seen is not null").groupBy("shingle").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= HOT)
    top = frequent.orderBy(F.col("seen").desc(), "shingle").limit(HOT_MOST).select("shingle").toArrow().column("shingle")
    stars = _stars(_prefix_rows(docs.where("doc_id is not null"), np.sort(top.to_numpy().astype(np.int64).view(np.uint64))))

    pairs = stars.where("n <= lead_most and lead_n <= most").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    links = _linked(_bounded(pairs, nodes), docs, nodes)
    parts = connected_components(links)

    # a group of two is settled; so is one whose nodes are all linked to the first
    linked = links.select(F.col("a").alias("node"), F.col("b").alias("lead"), F.lit(1).alias("ok"))
    open_groups = stars.join(linked, ["node", "lead"], "left").groupBy("shingle").agg(F.count(F.lit(1)).alias("rows"), F.count("ok").alias("oks")).where("rows > 1 and oks < rows").select("shingle")
    rest = materialize(stars.join(open_groups, "shingle", "left_semi"), "open")
    leads = rest.select("shingle", F.col("lead").alias("node"), F.col("lead_n").alias("n"), F.col("lead_most").alias("most")).distinct()
    both = rest.select("shingle", "node", "n", "most").union(leads)
    label = both.join(parts.withColumnRenamed("component", "c"), "node", "left").select("shingle", "node", "n", "most", F.coalesce("c", "node").alias("component"))
    more = _linked(_bounded(_tile_pairs(label, nodes), nodes), docs, nodes)

    # rows of one doc_id are one document: tie its texts together
    ids = members.where("n > 0 and doc_id is not null").select("doc_id", "node").distinct()
    same = ids.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    edges = links.union(more).union(same.join(ids, "doc_id").select("a", F.col("node").alias("b")).where("a <> b"))
    final = connected_components(edges)
    of_node = members.where("n > 0").select("node", "doc_id").join(final, "node", "left").withColumn("c", F.coalesce("component", "node"))
    lowest = of_node.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    of_node = materialize(of_node.select("node", "c").distinct().join(lowest, "c").select(F.col("node").alias("k"), "component_id"), "components")
    joined = members.join(of_node, (F.col("node") == F.col("k")) & (F.col("n") > 0), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
