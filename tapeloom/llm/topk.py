"""Exact top-k by inner product with no-random-access aggregation over sorted lists.

Each shard holds one list for each dimension, sorted by component. A query reads the lists in step, a run of
entries at a time, from the end that its own component favours. A row that has been met has a lower and an
upper bound: what was read of it, plus the worst or the best that the rest of each list it was not met in
allows. Rows that were met nowhere share one threshold, the sum of the best unread entries. Reading stops when the
threshold and all but a few upper bounds are under the k-th best lower bound; the few are resolved by reading
on for their entries alone."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .vectors import best, clean, distinct_vectors, flatten, one_vector, pick, query_blocks, shards

SHARD_ROWS = 16384
#: Runs that a list is read in; candidates left at which reading for all rows stops.
STEPS, FEW = 16, 64
#: Parts of the lists at whose ends, from a half on, a block of queries is looked at; queries of such a block.
DEPTHS, TOGETHER = 4, 64
#: Entries of a run at least.
LEAST = 128
#: Rows of a shard that are searched first, so that the rest starts from their k-th best score.
PILOT = 1024
#: Sums under this are exact in double precision, in which the lists are read.
EXACT = float(1 << 53)


def lists_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each dimension the rows in rising order of their components, these components, and each row's place in the
    list, which tells whether it was met by a depth."""
    by_dim = np.ascontiguousarray(x.T)
    order = np.argsort(by_dim, axis=1, kind="stable")
    place = np.empty(order.shape, np.uint16 if len(x) <= 1 << 16 else np.uint32)
    np.put_along_axis(place, order, np.arange(len(x), dtype=place.dtype)[None, :], axis=1)
    return order, np.take_along_axis(by_dim, order, axis=1), place


def read_lists(lists: tuple[np.ndarray, np.ndarray, np.ndarray], q: np.ndarray, k: int, floor: float = -np.inf) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows, scores, entries read before the stop): all rows that can be among the k best products with q, ties
    included, with their exact scores. Lists in which q is zero are not read.

    floor: a score that k rows elsewhere reach already.
    """
    order, values, place = lists
    rising, d, n = q < 0, int(np.count_nonzero(q)), order.shape[1]
    if not d or n <= max(FEW, k):
        return np.arange(n), _rest(order, values, q, np.arange(n), np.zeros(n), np.zeros(len(q), np.int64), np.full(len(q), n)), d * n
    worst = np.where(rising, values[:, -1], values[:, 0]) * q  # the last entry of each list
    # of the bounds' single precision
    slack = 1e-4 * np.maximum(np.abs(values[:, 0] * q), np.abs(values[:, -1] * q)).sum()
    up, down = np.flatnonzero(rising), np.flatnonzero(q > 0)
    lines = np.concatenate([up, down])[:, None]
    got = np.zeros(n)
    left = None  # candidates, once no row outside of what was met can be one
    step, at = max(LEAST, -(-n // STEPS)), 0
    while at < n:
        to = min(n, at + step)
        run = lambda part: np.concatenate([part[up, at:to], part[down, n - to : n - at]])
        got += np.bincount(run(order).ravel(), (run(values) * q[lines]).ravel(), n)
        at = to
        if at == n:
            break
        best = np.where(rising, values[:, min(at, n - 1)], values[:, n - 1 - at]) * q  # the best unread entries
        if left is None and best.sum() >= floor and (floor > -np.inf or at // step % 4):
            continue  # rows that were not met may be anywhere
        kth = floor
        if left is None:
            held, part = slice(None), place
        else:
            held, part = left, place[:, left]
        # which rows were met in which list
        part = ((part >= np.where(rising, at, n - at).astype(place.dtype)[:, None]) ^ rising[:, None]).astype(np.float32)
        reach = got[held] + best.sum() - best.astype(np.float32) @ part + slack
        if floor == -np.inf:  # the least bounds of the rows met give the k-th best
            lower = got[held] + worst.sum() - worst.astype(np.float32) @ part - slack
            kth = float(np.partition(lower, len(lower) - k)[len(lower) - k])
        if left is not None or best.sum() < kth:
            left = np.flatnonzero(reach >= kth) if left is None else left[reach >= kth]
            if len(left) <= max(FEW, k):
                break
    rows = left
    if rows is None:  # all was read, so all sums are whole
        rows = np.flatnonzero(got >= max(floor, float(np.partition(got, n - k)[n - k])))
    ends = np.where(rising, at, 0), np.where(rising, n, n - at)
    return rows, _rest(order, values, q, rows, got, *ends), at * d


def read_block(lists: tuple[np.ndarray, np.ndarray, np.ndarray], qs: np.ndarray, k: int, floors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, scores) of each of the queries, as read_lists gives them: the lists are read in step to a few common depths, and what a
    run adds to sums and bounds is one product for all queries, with the entries that were not met as zeros.

    floors: for each query a score that k rows elsewhere reach already.
    """
    order, values, place = lists
    d, n = order.shape
    entries = np.take_along_axis(values, place.astype(np.int64), axis=1)
    up, down = np.minimum(qs, 0), np.maximum(qs, 0)
    slack = 1e-4 * np.maximum(np.abs(values[:, 0] * qs), np.abs(values[:, -1] * qs)).sum(axis=1)
    found: list = [None] * len(qs)
    left = np.arange(len(qs))
    for at in (*(n * part // DEPTHS for part in range(DEPTHS // 2, DEPTHS) if n > 4 * max(FEW, k)), n):
        low, high = place < at, place >= n - at
        got = down[left] @ np.where(high, entries, 0) + up[left] @ np.where(low, entries, 0)
        if at == n:
            for i, own in zip(left, got):
                rows = np.flatnonzero(own >= max(floors[i], float(np.partition(own, n - k)[n - k]) if n > k else -np.inf))
                found[i] = rows, own[rows]
            break
        best = values[:, n - 1 - at] * down[left] + values[:, at] * up[left]  # the best unread entries
        if (best.sum(axis=1) >= floors[left]).all() and np.isfinite(floors[left]).all():
            continue  # rows that were not met may be anywhere
        bound = lambda c: c.sum(axis=1)[:, None] - ((c * (down[left] > 0)).astype(np.float32) @ high.astype(np.float32) + (c * (up[left] < 0)).astype(np.float32) @ low.astype(np.float32))
        lower = got + bound(values[:, 0] * down[left] + values[:, -1] * up[left]) - slack[left, None]
        kth = np.maximum(floors[left], np.partition(lower, n - k, axis=1)[:, n - k])
        reach = got + bound(best) + slack[left, None] >= kth[:, None]
        done = (best.sum(axis=1) < kth) & (reach.sum(axis=1) <= max(FEW, k))
        for i, own, near in zip(left[done], got[done], reach[done]):
            rows = np.flatnonzero(near)
            found[i] = rows, _rest(order, values, qs[i], rows, own, np.where(qs[i] < 0, at, 0), np.where(qs[i] < 0, n, n - at))
        left = left[~done]
        if not len(left):
            break
    return found


def _opened(values: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists as lists_of makes them; the order is the inverse of the places, which are smaller to carry."""
    order = np.empty(place.shape, np.int64)
    np.put_along_axis(order, place.astype(np.int64), np.arange(place.shape[1])[None, :], axis=1)
    return order, values, place


def _rest(order: np.ndarray, values: np.ndarray, q: np.ndarray, rows: np.ndarray, got: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """got of the rows, completed by reading each list on, from start to end, for the entries of these rows."""
    wanted = np.zeros(len(got), bool)
    wanted[rows] = True
    total = got.copy()
    for line, x, c, a, b in zip(order, values, q, start, end):
        if not c:
            continue
        hits = np.flatnonzero(wanted[line[a:b]]) + a
        total[line[hits]] += x[hits] * c
    return total[rows]


def resolved(x: np.ndarray, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """x[rows] @ q of integers held as doubles: as integers of any size where doubles could be off."""
    if (np.abs(x[rows]) @ np.abs(q)).max(initial=0) < EXACT:
        return x[rows] @ q
    own = [int(c) for c in q.tolist()]
    out = np.empty(len(rows), object)
    out[:] = [sum(int(a) * b for a, b in zip(row, own)) for row in x[rows].tolist()]
    return out


def top_products(table: DataFrame, every: int = 50, k: int = 5, scale: int = 256, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products of each row whose vec_id is divisible
    by `every` with all other rows, components being floor(scale * x).

    Equal integer vectors are kept once with their smallest ids. Vectors null, empty or with null or
    non-finite components take no part, zero vectors do; scores are exact integers, and components or
    scores of the result beyond 64 bits are an error, as in SQL; repeated rows count once, and of different vectors of one
    vec_id one counts (`one_vector`), as query and as candidate; vectors meet those of their own length only; fewer candidates than k give fewer rows; an empty table
    gives none. Extra columns are not read.
    """
    fits = lambda x: F.abs(x * F.lit(float(scale))) < F.lit(float(1 << 63))
    whole = F.transform("v", lambda x: F.when(fits(x), F.floor(x * F.lit(float(scale))).cast("double")).otherwise(F.raise_error(F.lit("a component is beyond 64 bits")).cast("double")))
    rows = one_vector(clean(table)).select("vec_id", whole.alias("v"))
    placed, counts = shards(materialize(distinct_vectors(rows, k + 1), "integers"), shard_rows)

    def build(key: tuple, part: pa.Table) -> pa.Table:
        lists = part.column("ids").to_pylist()
        x = np.array(part.column("v").to_pylist(), np.float64)
        offsets, ids = flatten(lists)
        out = io.BytesIO()
        parts = {f"{name}{part}": c for part, rows in enumerate((x[:PILOT], x[PILOT:])) if len(rows) for name, c in zip(("values", "place"), lists_of(rows)[1:])}
        np.savez(out, x=x, offsets=offsets, ids=ids, **parts)
        return pa.table({"dim": pa.array([x.shape[1]], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "payload": pa.array([out.getvalue()], pa.binary())})

    index = placed.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, payload binary")
    tasks = query_blocks(rows.where(F.col("vec_id") % every == 0), counts).join(index, ["dim", "shard"]).select("dim", "ids", "vectors", "payload")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, ids, vectors, payload in zip(*(batch.column(c) for c in ("dim", "ids", "vectors", "payload"))):
                z = np.load(io.BytesIO(payload.as_py()))
                x, offsets, members = (z[c] for c in ("x", "offsets", "ids"))
                parts = [(rows, np.abs(rows).max(axis=0), _opened(z[f"values{part}"], z[f"place{part}"]), part * PILOT) for part, rows in enumerate((x[:PILOT], x[PILOT:])) if len(rows)]
                own = np.frombuffer(ids.as_py(), "<i8")
                qs = np.frombuffer(vectors.as_py(), np.float64).reshape(len(own), dim.as_py())
                out: list[list] = [[], [], []]
                every: list[list] = [[] for _ in own]
                floors = np.full(len(own), -np.inf)
                for xs, most, lists, base in parts:
                    exact = np.abs(qs) @ most < EXACT
                    for block in np.array_split(np.flatnonzero(exact), max(1, -(-int(exact.sum()) // TOGETHER))):
                        # the query's own vector may fill a place, so one more is kept
                        for i, (near, score) in zip(block, read_block(lists, qs[block], k + 1, floors[block])):
                            every[i].append((near + base, score))
                    for i in np.flatnonzero(~exact):  # beyond double precision: each row's sum by integers of any size
                        every[i].append((np.arange(len(xs)) + base, resolved(xs, np.arange(len(xs)), qs[i])))
                    for i, found in enumerate(every):
                        if len(score := found[-1][1]) > k:
                            floors[i] = max(floors[i], float(sorted(score.tolist())[-k - 1]))
                for q_id, found in zip(own.tolist(), every):
                    rows, score = (np.concatenate(c) for c in zip(*found))
                    for vec, s in pick(score, rows, offsets, members, q_id, k, False):
                        out[0].append(q_id)
                        out[1].append(vec)
                        out[2].append(int(s))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["query_id", "vec_id", "score"])

    return best(tasks.mapInArrow(search, "query_id long, vec_id long, score long"), k, False)
