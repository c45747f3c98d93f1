"""Approximate nearest neighbours: a hierarchical navigable small-world graph for each shard, kept as flat
neighbour arrays in an index table; every query visits every shard and the shard results are merged."""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import best, clean, distinct_vectors, flatten, one_vector, pick, query_blocks, shards

#: Distinct vectors of a shard: bounds a task's memory and its build time.
SHARD_ROWS = 8192
LINKS, BUILD_WIDTH, SEARCH_WIDTH = 12, 64, 192
#: Components up to which SEARCH_WIDTH serves; beyond, nearness tells less and the width grows with their root.
WIDTH_DIM = 64


def width_of(dim: int) -> int:
    """Nodes held in a search among vectors of so many components."""
    return max(SEARCH_WIDTH, math.ceil(SEARCH_WIDTH * math.sqrt(dim / WIDTH_DIM)))


class Graph:
    """vectors, top level of each node, and for each level an array of neighbours (-1: none).

    Distances are squares of differences in double precision, of vectors moved to their mean and scaled, so
    that neither an offset nor the size of the components costs digits.
    """

    def __init__(self, vectors: np.ndarray, links: int = LINKS, seed: int = 7):
        self._centre(vectors)
        n = len(self.v)
        u = np.random.default_rng(seed).random(n)
        self.top = np.minimum((-np.log(1 - u) / math.log(links)).astype(np.int32), 12)
        self.links = links
        self.near = [np.full((n if lv == 0 else int((self.top >= lv).sum()), links * (2 if lv == 0 else 1)), -1, np.int32) for lv in range(int(self.top.max(initial=0)) + 1)]
        self._index()
        self.entry = -1

    def _centre(self, vectors: np.ndarray) -> None:
        self.scale = max(float(np.abs(vectors).max(initial=0)), 1e-300)
        self.mean = (vectors / self.scale).mean(axis=0) if len(vectors) else 0.0
        self.v = np.ascontiguousarray(vectors / self.scale - self.mean)

    def _index(self) -> None:
        """Row of each node in each level's array."""
        self.row = [np.where(self.top >= lv, np.cumsum(self.top >= lv) - 1, -1) for lv in range(len(self.near))]
        self.stamp, self.now = np.zeros(len(self.v), np.int64), 0

    def _distance(self, nodes: np.ndarray, q: np.ndarray) -> np.ndarray:
        apart = self.v[nodes] - q
        return np.einsum("ij,ij->i", apart, apart)

    def _layer(self, q: np.ndarray, start: list[tuple[float, int]], width: int, lv: int) -> list[tuple[float, int]]:
        """The `width` nearest nodes found on a level, nearest first."""
        self.now += 1
        stamp, now, near, row = self.stamp, self.now, self.near[lv], self.row[lv]
        todo, found = list(start), [(-d, i) for d, i in start]
        heapq.heapify(todo)
        heapq.heapify(found)
        stamp[[i for _, i in start]] = now
        while todo:
            d, i = heapq.heappop(todo)
            if d > -found[0][0] and len(found) >= width:
                break
            nb = near[row[i]]
            nb = nb[nb >= 0]
            nb = nb[stamp[nb] != now]
            if not len(nb):
                continue
            stamp[nb] = now
            for x, j in zip(self._distance(nb, q).tolist(), nb.tolist()):
                if len(found) < width:
                    heapq.heappush(found, (-x, j))
                    heapq.heappush(todo, (x, j))
                elif x < -found[0][0]:
                    heapq.heapreplace(found, (-x, j))
                    heapq.heappush(todo, (x, j))
        return sorted((-d, i) for d, i in found)

    def _spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Neighbours that are nearer to the node than to one another; the nearest others fill up."""
        nodes = np.array([i for _, i in found])
        if len(nodes) <= most:
            return nodes.tolist()
        v = self.v[nodes]
        norm = (v * v).sum(axis=1)
        between = norm[:, None] + norm[None, :] - 2 * (v @ v.T)
        own = np.array([x for x, _ in found])
        kept: list[int] = []
        closest = np.full(len(nodes), np.inf)
        for k in range(len(nodes)):
            if own[k] < closest[k]:
                kept.append(k)
                if len(kept) == most:
                    break
                np.minimum(closest, between[k], out=closest)
        if len(kept) < most:
            chosen = set(kept)
            kept += [k for k in range(len(nodes)) if k not in chosen][: most - len(kept)]
        return nodes[kept].tolist()

    def add(self, i: int, width: int = BUILD_WIDTH) -> None:
        lv_i = int(self.top[i])
        if self.entry < 0:
            self.entry = i
            return
        q = self.v[i]
        at = [(float(self._distance(np.array([self.entry]), q)[0]), self.entry)]
        for lv in range(int(self.top[self.entry]), -1, -1):
            if lv > lv_i:
                at = self._layer(q, at, 1, lv)[:1]
                continue
            at = self._layer(q, at, width, lv)
            near, row = self.near[lv], self.row[lv]
            chosen = self._spread(at, self.links)
            near[row[i], : len(chosen)] = chosen
            for j in chosen:
                line = near[row[j]]
                free = np.flatnonzero(line < 0)
                if len(free):
                    line[free[0]] = i
                else:
                    all_of = np.append(line, i)
                    d = self._distance(all_of, self.v[j])
                    order = np.argsort(d)
                    keep = self._spread([(float(d[k]), int(all_of[k])) for k in order], len(line))
                    line[:] = -1
                    line[: len(keep)] = keep
        if lv_i > int(self.top[self.entry]):
            self.entry = i

    @classmethod
    def build(cls, vectors: np.ndarray) -> "Graph":
        g = cls(vectors)
        for i in range(len(vectors)):
            g.add(i)
        return g

    def search(self, q: np.ndarray, width: int | None = None) -> np.ndarray:
        q = q / self.scale - self.mean
        width = width or width_of(len(q))
        at = [(float(self._distance(np.array([self.entry]), q)[0]), self.entry)]
        for lv in range(int(self.top[self.entry]), 0, -1):
            at = self._layer(q, at, 1, lv)[:1]
        return np.array([i for _, i in self._layer(q, at, width, 0)])

    def dump(self, vectors: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> bytes:
        """vectors: the original ones in double precision."""
        out = io.BytesIO()
        np.savez(out, vectors=vectors, top=self.top, entry=self.entry, offsets=offsets, ids=ids, **{f"near{k}": x for k, x in enumerate(self.near)})
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> tuple["Graph", np.ndarray, np.ndarray, np.ndarray]:
        z = np.load(io.BytesIO(data))
        g = cls.__new__(cls)
        g._centre(z["vectors"])
        g.top, g.entry, g.links = z["top"], int(z["entry"]), LINKS
        g.near = [z[f"near{k}"] for k in range(int(g.top.max(initial=0)) + 1)]
        g._index()
        return g, z["vectors"], z["offsets"], z["ids"]


def _taking_part(table: DataFrame) -> DataFrame:
    return one_vector(clean(table).where(F.exists("v", lambda x: x != 0)))


def build_index(table: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, DataFrame]:
    """Index table (dim, shard, payload) of all vectors, and the shard count of each dimension."""
    rows = _taking_part(table)
    placed, counts = shards(materialize(distinct_vectors(rows, k + 1), "vectors"), shard_rows)

    def build(key: tuple, part: pa.Table) -> pa.Table:
        order = np.argsort([x[0] for x in part.column("ids").to_pylist()], kind="stable")
        vectors = np.array(part.column("v").to_pylist(), np.float64)[order]
        lists = part.column("ids").to_pylist()
        graph = Graph.build(vectors)
        payload = graph.dump(vectors, *flatten([lists[i] for i in order]))
        return pa.table({"dim": pa.array([vectors.shape[1]], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "payload": pa.array([payload], pa.binary())})

    index = placed.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, payload binary")
    return materialize(index, "hnsw"), counts


def nearest(table: DataFrame, every: int = 100, k: int = 10, shard_rows: int = SHARD_ROWS, width: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row whose vec_id is divisible by `every`.

    Score: Euclidean distance in double precision. Equal vectors are indexed once with their smallest ids, so
    ties go to the smaller vec_id whatever the group's size. Vectors null, zero, empty or with null or
    non-finite components take no part; vectors meet those of their own length only; repeated rows count
    once, and of different vectors of one vec_id one counts (`one_vector`), as query and as candidate; fewer candidates than k give fewer rows; an empty table gives none. Extra columns are not read.
    """
    index, counts = build_index(table, k, shard_rows)
    queries = _taking_part(table).where(F.col("vec_id") % every == 0)
    tasks = query_blocks(queries, counts).join(index, ["dim", "shard"]).select("dim", "ids", "vectors", "payload")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, vectors, payload in zip(*(batch.column(c) for c in ("dim", "ids", "vectors", "payload"))):
                graph, exact, offsets, members = Graph.load(payload.as_py())
                own = np.frombuffer(ids.as_py(), "<i8")
                qs = np.frombuffer(vectors.as_py(), np.float64).reshape(len(own), dim.as_py())
                out: list[list] = [[], [], []]
                for q_id, q in zip(own.tolist(), qs):
                    rows = graph.search(q, width)
                    score = np.sqrt(((exact[rows] - q) ** 2).sum(axis=1))
                    for vec, s in pick(score, rows, offsets, members, q_id, k, True):
                        out[0].append(q_id)
                        out[1].append(vec)
                        out[2].append(s)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    return best(tasks.mapInArrow(search, "query_id long, vec_id long, score double"), k, True)
