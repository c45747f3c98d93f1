"""MinHash near-dedup with sequential Bayesian verification, down to the groups of linked documents.

Equal sets of shingles are one node (by a 128-bit hash). A node has a signature in two parts: band keys, each of a few
minimum hashes, and independent minimum hashes of one byte. Nodes with a common band key are candidates. Their byte
hashes are compared in batches: with m of n equal, the similarity has a beta posterior, and a pair goes as soon as the
probability that it reaches the threshold is under MISS. All survivors are confirmed on full sets.

Two rounds keep groups of near copies linear without losing a link:
1. Star: each node of a band's group against the group's first node. Copies in thousands link up here.
2. Tiles: groups whose nodes are not all of one component yet are compared pairwise, large groups in blocks. The rows
   that are left a partner of another component come together once more, now with their texts, and the likeliest pairs
   are confirmed first: a tile gives out links that join its components, not all of its links.

A pair at the threshold misses all bands with a probability of (1 - 0.85^4)^20, under one in a million; the batches add
about MISS each.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, materialize
from .shingles import mix, shingle_sets
from .tokens import slices

WORDS, PERCENT = 3, 85
BANDS, ROWS = 20, 4
BATCH, BATCHES = 32, 4
#: Probability with which a batch may drop a pair that links.
MISS = 1e-6
#: Shingles that are hashed at once, rows of a block, partners that are confirmed in one task.
CHUNK, TILE, SALT_ROWS = 1 << 15, 1024, 4096
#: Bits of the filter that keeps unneeded texts from being moved.
FILTER = 1 << 23

_U = np.uint64
_FACTORS = mix(np.arange(1, BANDS * ROWS + BATCH * BATCHES + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_OFFSETS = mix(np.arange(1, len(_FACTORS) + 1, dtype=_U) * _U(0xD1B54A32D192ED03))


def least_equal(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """For each number of batches compared, the equal bytes that a pair needs to go on: under a uniform prior, m of n
    equal give P(p >= t) = P(Binomial(n + 1, t) <= m). Unequal hashes agree in a byte in one of 256 cases."""
    t = percent / 100 + (1 - percent / 100) / 256
    out = []
    for n in range(BATCH, BATCH * BATCHES + 1, BATCH):
        below, m = 0.0, -1
        while below < miss:
            m += 1
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of non-empty sets: identity (k, 2) and band keys (k, BANDS) as int64, byte hashes (k, BATCH * BATCHES) as uint8."""
    k, hashes = len(sets), len(_FACTORS)
    ids, low = np.zeros((k, 2), _U), np.zeros((hashes, k), _U)
    begin = 0
    while begin < k:
        end, size = begin, 0
        while end < k and (end == begin or size + len(sets[end]) <= CHUNK):
            size += len(sets[end])
            end += 1
        x = np.concatenate(sets[begin:end])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[begin : end - 1]])]).astype(np.int64)
        for c in range(2):
            ids[begin:end, c] = np.add.reduceat(mix(x * _FACTORS[c] + _OFFSETS[c]), starts)
        v = np.empty_like(x)
        for i in range(hashes):
            np.multiply(x, _FACTORS[i], out=v)
            np.add(v, _OFFSETS[i], out=v)
            low[i, begin:end] = np.minimum.reduceat(v, starts)
        begin = end
    keys = np.zeros((BANDS, k), _U)
    for b in range(BANDS):
        for r in range(ROWS):
            keys[b] = mix(keys[b] + low[b * ROWS + r] + _OFFSETS[b])
    return ids.view(np.int64), keys.T.copy().view(np.int64), (mix(low[BANDS * ROWS :]) & _U(255)).astype(np.uint8).T.copy()


def _texts(batches: Iterator[pa.RecordBatch], *names: str):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for a, b in slices(texts):
            yield batch.slice(a, b - a).select(list(names)), texts[a:b]


def _describe(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n, h1, h2, keys, bytes) of every document; the last four are null without shingles."""

    def describe(batches):
        for own, texts in _texts(batches, "doc_id"):
            sets = shingle_sets(texts, WORDS)
            full = [k for k, s in enumerate(sets) if len(s)]
            at = np.full(len(sets), -1, np.int64)
            at[full] = np.arange(len(full))
            at = pa.array(at, pa.int64(), mask=at < 0)
            ids, keys, marks = signatures([sets[k] for k in full]) if full else (np.zeros((0, 2), np.int64), np.zeros((0, BANDS), np.int64), np.zeros((0, BATCH * BATCHES), np.uint8))
            columns = [pa.array(ids[:, 0]), pa.array(ids[:, 1]), pa.array(list(keys), pa.list_(pa.int64())), pa.array([m.tobytes() for m in marks], pa.binary())]
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array([len(s) for s in sets], pa.int64()), *[c.take(at) for c in columns]], ["doc_id", "n", "h1", "h2", "keys", "bytes"])

    out = docs.mapInArrow(describe, "doc_id long, n long, h1 long, h2 long, keys array<long>, bytes binary")
    return materialize(out.withColumn("row", F.monotonically_increasing_id()), "signed")


def _alive(x: np.ndarray, y: np.ndarray, least: list[int]) -> np.ndarray:
    """Places of the rows of x and y, (k, BATCH * BATCHES) each, that no batch drops."""
    at, equal = np.arange(len(x)), np.zeros(len(x), np.int64)
    for b, m in enumerate(least):
        part = slice(b * BATCH, (b + 1) * BATCH)
        equal += np.count_nonzero(x[at, part] == y[at, part], axis=1)
        keep = equal >= m
        at, equal = at[keep], equal[keep]
    return at


def _like(a: str, b: str) -> Column:
    """Sizes that admit a link."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def _star_pairs(bands: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): a node and the first node of one of its band groups, where the byte hashes let the pair pass."""
    first = bands.groupBy("key").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("rows")).where("rows > 1").drop("rows")
    pairs = bands.join(first, "key").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    own = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bytes").alias("xa"))
    other = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bytes").alias("xb"))
    least = least_equal()

    def judge(batches):
        for t in batches:
            x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint8).reshape(len(t), -1) for c in ("xa", "xb"))
            yield t.select(["a", "b"]).take(pa.array(_alive(x, y, least)))

    met = pairs.join(own, "a").join(other, "b").where(_like("na", "nb")).select("a", "b", "xa", "xb")
    return materialize(met.mapInArrow(judge, "a long, b long"), "near")


def _tiles(rows: DataFrame) -> DataFrame:
    """rows (key, ...) with a tile: groups of at most TILE rows are one; larger ones are cut into blocks of about TILE
    rows, a tile is a pair of blocks, and each row goes to the tiles of its block only."""
    blocks = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE)).cast("int").alias("blocks"))
    placed = rows.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pair = lambda j: F.struct(F.least(F.col("block"), j).alias("i"), F.greatest(F.col("block"), j).alias("j"))
    return placed.withColumn("tile", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair))).drop("blocks")


def _whole_groups(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.Table]:
    """Tables of at least so many rows (the last: fewer) that end where a place ends. Rows come by place."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if len(batch):
            held.append(batch)
        if sum(map(len, held)) > rows:
            t = pa.Table.from_batches(held)
            place = t.column("place").to_numpy()
            before = np.flatnonzero(place != place[-1])  # the last group may go on
            if len(before):
                yield t.slice(0, before[-1] + 1)
                t = t.slice(before[-1] + 1)
            held = t.to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _columns(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t.column(c).to_numpy() for c in names]


def _marks(t: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("bytes").to_pylist()), np.uint8).reshape(len(t), -1)


def _met(t: pa.Table, marks: np.ndarray, least: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of pairs of one group and different components that sizes and byte hashes let pass. Rows of a group are
    in order of size; in tiles of two blocks, pairs within a block are those of the block's own tile."""
    place, node, n, part, block = _columns(t, "place", "node", "n", "component", "block")
    edge = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1, [len(t)]])
    stop, i, shift = np.repeat(edge[1:], np.diff(edge)), np.arange(len(t)), 1
    while len(i := i[i + shift < stop[i]]):
        i = i[100 * n[i] >= PERCENT * n[i + shift]]
        j = i + shift
        x = i[(part[i] != part[j]) & (node[i] != node[j]) & ((block[i] < 0) | (block[i] != block[j]))]
        for k in range(0, len(x), 4096):
            y = x[k : k + 4096]
            y = y[_alive(marks[y], marks[y + shift], least)]
            if len(y):
                yield y, y + shift
        shift += 1


_TILE = "place long, node long, n long, component long, block int"


def _open_rows(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(place, node, n, component, block): the rows of tiles that the byte hashes leave a partner of another component.
    rows: (key, node, component)."""
    full = _tiles(rows).join(nodes.select("node", "n", "bytes"), "node")
    block = F.when(F.col("tile.i") == F.col("tile.j"), -1).otherwise(F.col("block")).alias("block")
    tiled = full.select(F.xxhash64("key", "tile").alias("place"), "node", "n", "component", block, "bytes")
    least, names = least_equal(), [c.split()[0] for c in _TILE.split(", ")]

    def compare(batches):
        for t in _whole_groups(batches):
            open_ = np.zeros(len(t), bool)
            for i, j in _met(t, _marks(t), least):
                open_[i] = open_[j] = True
            yield from t.select(names).filter(pa.array(open_)).to_batches()

    return materialize(tiled.repartition("place").sortWithinPartitions("place", "n", "node").mapInArrow(compare, _TILE), "open")


class _Sets:
    """Sets of compressed texts, of which the last ones are kept, up to a number of shingles."""

    def __init__(self, texts: list[bytes], most: int = 1 << 24):
        self.texts, self.most, self.kept, self.size = texts, most, {}, 0
        self.unpack = zstandard.ZstdDecompressor().decompress

    def __getitem__(self, k: int) -> np.ndarray:
        if k not in self.kept:
            if self.size > self.most:
                self.kept, self.size = {}, 0
            self.kept[k] = shingle_sets([self.unpack(self.texts[k]).decode("utf-8", "surrogatepass")], WORDS)[0]
            self.size += len(self.kept[k])
        return self.kept[k]


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


def _tile_links(rows: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): links that join all of a tile's components which links of the tile join. The texts of a tile come
    together once; the likeliest pairs are confirmed first, and pairs of one component by then are passed over."""
    texts = _needed(rows.select("node").distinct(), docs, nodes)
    full = rows.join(nodes.select("node", "bytes"), "node").join(texts, "node").select("place", "node", "n", "component", "block", "bytes", "z")
    least = least_equal()

    def confirm(batches):
        for t in _whole_groups(batches, 2_000):
            place, node, part = _columns(t, "place", "node", "component")
            marks, sets, found = _marks(t), _Sets(t.column("z").to_pylist()), []
            met = list(_met(t, marks, least))
            if not met:
                continue
            i, j = (np.concatenate([m[k] for m in met]) for k in (0, 1))
            equal = np.concatenate([np.count_nonzero(marks[a] == marks[b], axis=1) for a, b in met])
            order = np.lexsort((j, i, -equal, place[i]))  # place by place
            i, j = i[order], j[order]
            edge = np.concatenate([[0], np.flatnonzero(np.diff(place[i])) + 1, [len(i)]])
            for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
                own = np.arange(np.searchsorted(place, place[i[a]], "left"), np.searchsorted(place, place[i[a]], "right"))
                label = part[own].copy()
                for k in range(a, b, 1024):
                    x, y = i[k : min(b, k + 1024)], j[k : min(b, k + 1024)]
                    differ = label[x - own[0]] != label[y - own[0]]
                    for p, q in zip(x[differ].tolist(), y[differ].tolist()):
                        u, v = label[p - own[0]], label[q - own[0]]
                        if u != v and _linked(sets[p], sets[q]):
                            label[label == u] = v
                            found.append((max(node[p], node[q]), min(node[p], node[q])))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    links = materialize(full.repartition("place").sortWithinPartitions("place", "n", "node").mapInArrow(confirm, "a long, b long").distinct(), "links")
    discard(texts)
    return links


def _place(c: str) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(FILTER)).cast("int")


def _needed(wanted: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, z): the compressed texts of the wanted nodes. A filter of hashed ids, gathered as words of 64 bits, keeps
    most other texts from being moved."""
    wanted = materialize(wanted.join(nodes.select("node", "doc_id", "h1", "h2"), "node"), "wanted")
    words = wanted.select(_place("doc_id").alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p") % 64)).alias("on")).toArrow()
    bits = np.zeros(FILTER // 64, np.int64)
    bits[words.column("word").to_numpy()] = words.column("on").to_numpy()
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def let_in(batches):
        on, pack = held.value, zstandard.ZstdCompressor(3).compress
        for t in batches:
            p = t.column("p").to_numpy()
            t = t.filter(pa.array((on[p >> 6] >> (p & 63)) & 1 == 1))
            yield pa.RecordBatch.from_arrays([t.column("doc_id"), pa.array([pack(x.encode("utf-8", "surrogatepass")) for x in t.column("text").to_pylist()], pa.binary())], ["doc_id", "z"])

    def own(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for t in batches:  # rows of one doc_id may differ in text
            keep = []
            for z, h1, h2 in zip(t.column("z"), t.column("h1").to_pylist(), t.column("h2").to_pylist()):
                s = shingle_sets([unpack(z.as_py()).decode("utf-8", "surrogatepass")], WORDS)[0]
                keep.append(bool(len(s)) and signatures_id(s) == (h1, h2))
            yield t.select(["node", "z"]).filter(pa.array(keep, pa.bool_()))

    texts = docs.where("doc_id is not null and text is not null").select("doc_id", "text", _place("doc_id").alias("p")).mapInArrow(let_in, "doc_id long, z binary")
    # shuffled at any size: a plan that broadcasts while few are wanted would move more only as they grow
    found = texts.join(wanted.hint("shuffle_hash"), "doc_id").select("node", "h1", "h2", "z").mapInArrow(own, "node long, z binary")
    out = materialize(found.dropDuplicates(["node"]), "texts")
    discard(wanted)
    return out


def _confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that link by their full sets. The text of each a goes, compressed, to its b; a b with very
    many partners is sent to as many tasks as it takes."""
    needed = _needed(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), docs, nodes)
    salts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / F.lit(SALT_ROWS)).cast("int").alias("salts"))
    salted = pairs.join(salts, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"))
    members = needed.join(salted.withColumnRenamed("a", "node"), "node").select("b", "salt", F.col("node").alias("a"), "z")
    heads = needed.join(salts.withColumnRenamed("b", "node"), "node").select(F.col("node").alias("b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("a"), "z")
    together = heads.union(members).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())

    def exact(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        head, full = None, np.zeros(0, _U)
        for t in batches:
            found_a, found_b = [], []
            for b, a, z in zip(t.column("b").to_pylist(), t.column("a").to_pylist(), t.column("z")):
                s = shingle_sets([unpack(z.as_py()).decode("utf-8", "surrogatepass")], WORDS)[0]
                if a is None:
                    head, full = b, s
                elif head == b and _linked(s, full):
                    found_a.append(a)
                    found_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], ["a", "b"])

    links = materialize(together.mapInArrow(exact, "a long, b long").distinct(), "links")
    discard(needed)
    return links


def signatures_id(s: np.ndarray) -> tuple[int, int]:
    """The 128-bit identity of one non-empty set."""
    return tuple(int(np.add.reduce(mix(s * _FACTORS[c] + _OFFSETS[c])).view(np.int64)) for c in range(2))


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every document: the size of its set of 3-word shingles, the smallest
    doc_id reachable over links of a similarity of 0.85 or more, its own included, and whether that is its own.

    Null, empty or wordless texts have no shingles and are linked with nothing; texts of under three words are one
    shingle; texts of any length are taken whole. A row without doc_id gets no component and gives none (kept is null).
    Repeated rows stay; rows of one doc_id are one document for linking. An empty table gives no rows. Other
    columns are not read.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    described = _describe(docs)
    known = described.where("n > 0 and doc_id is not null")
    heads = known.groupBy("h1", "h2").agg(F.min("row").alias("node"))
    nodes = materialize(known.join(heads.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node"), "nodes")
    members = materialize(described.select("doc_id", "n", "h1", "h2").join(heads, ["h1", "h2"], "left").select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("node")).alias("node")), "members")
    bands = materialize(nodes.select(F.explode("keys").alias("key"), "node"), "bands")

    star = _star_pairs(bands, nodes)
    links = _confirmed(star, docs, nodes)
    parts = connected_components(links)

    label = bands.join(parts.withColumnRenamed("component", "c"), "node", "left").select("key", "node", F.coalesce("c", "node").alias("component"))
    label = materialize(label, "labelled")
    open_keys = label.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least < most").select("key")
    tiles = _open_rows(label.join(open_keys, "key", "left_semi"), nodes)
    more = _tile_links(tiles, docs, nodes)

    # rows of one doc_id are one document: tie its texts together
    ids = members.where("node is not null").select("doc_id", "node").distinct()
    same = ids.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z")
    final = connected_components(links.union(more).union(same.join(ids, "doc_id").select("a", F.col("node").alias("b")).where("a <> b")))
    of_node = ids.join(final, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("c"))
    lowest = of_node.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    of_node = materialize(of_node.select("node", "c").distinct().join(lowest, "c").select("node", "component_id"), "components")
    discard(described, nodes, bands, star, links, label, tiles, more)
    out = members.join(of_node, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
