"""Maximal periodic runs of words, by a suffix automaton with end-position sets merged small to large.

A run of period q and length L holds the same factor of L - q words twice, q apart. Among the automaton's states the one
of that factor has both end positions, and as q is the smallest period no occurrence lies between them: where the two
first come into one set, they are neighbours, and their distance is not beyond the state's length. Each such pair is a
square, which seeds a run; it is extended both ways as far as words q apart agree.

Only what can hold a run goes to the automaton. With a least length m and exponent e, L - q is at least m (e - 1) / e, so
each part of a run is covered by word grams of that size which come again in the text; every run lies in one stretch of
covered words, and the stretches are taken one by one. States shorter than such a gram seed no run and are not merged.

Texts are independent: there is no shuffle, and a task holds one slice of texts and one text's automaton at a time
(some 600 bytes a word of a covered stretch).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import mix
from .tokens import slices

LEAST_LENGTH, LEAST_EXPONENT = 24, 3
_BASE = np.uint64(0x9E3779B97F4A7C15)
RUNS = "array<struct<start:long,length:long,period:long>>"


def gram_size(least_length: int, least_exponent: int) -> int:
    """Words that a run's repeated factor has at least."""
    return -(-least_length * (least_exponent - 1) // least_exponent)


def repeated_stretches(ids: np.ndarray, gram: int) -> list[tuple[int, int]]:
    """Maximal stretches [a, b) of words covered by grams that come more than once. Equal hashes of other grams only
    make stretches longer."""
    n = len(ids) - gram + 1
    if n < 2:
        return []
    x = mix(ids.astype(np.uint64) + np.uint64(1))
    h = np.zeros(n, np.uint64)
    for k in range(gram):
        h = h * _BASE + x[k : n + k]
    ordered = np.sort(h)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(again):
        return []
    starts = np.flatnonzero(np.isin(h, again))
    change = np.zeros(len(ids) + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + gram, -1)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist()))


def automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(link, size, first) of the suffix automaton's states: suffix link, longest length, and the end position of states
    that are prefixes, -1 of clones. State 0 is the root."""
    follow: list[dict[int, int]] = [{}]
    link, size, first, last = [-1], [0], [-1], 0
    for i, c in enumerate(word):
        new = len(size)
        follow.append({})
        size.append(i + 1)
        first.append(i)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                clone = len(size)
                follow.append(follow[q].copy())
                size.append(size[p] + 1)
                first.append(-1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return link, size, first


def squares(word: list[int], least: int) -> dict[int, set[int]]:
    """Distance to end positions of squares: pairs of end positions that become neighbours in the set of a state of at
    least `least` words, no further apart than the state's length. The smaller set goes into the larger."""
    link, size, first = automaton(word)
    # negative and rising: a prefix ends before all that its set receives, so it goes to the list's end
    ends: list[list[int] | None] = [[-f] if f >= 0 else [] for f in first]
    found: dict[int, set[int]] = {}
    for v in sorted(range(1, len(size)), key=size.__getitem__, reverse=True):
        up = link[v]
        few, many, most = ends[v], ends[up], size[up]
        ends[v] = None
        if most < least:
            continue
        if len(few) > len(many):
            few, many = many, few
        if len(few) > 16:  # two sorted lists are merged in one pass
            many = sorted(many + few)
        for x in few:
            i = bisect_left(many, x)
            if i == len(many) or many[i] != x:
                many.insert(i, x)
            for y in (*many[max(0, i - 1) : i], *many[i + 1 : i + 2]):
                if (d := abs(x - y)) <= most:
                    found.setdefault(d, set()).add(-min(x, y))
        ends[up] = many
    return found


def _least_period(w: np.ndarray, d: int) -> bool:
    """Whether no divisor of d is a period of w, which has period d and at least twice its length."""
    rest, p, primes = d, 2, []
    while p * p <= rest:
        if rest % p == 0:
            primes.append(p)
            while rest % p == 0:
                rest //= p
        p += 1
    if rest > 1:
        primes.append(rest)
    return not any(np.array_equal(w[: -(d // p)], w[d // p :]) for p in primes)


def runs_of(ids: np.ndarray, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of at least that length and exponent, by start, then period."""
    gram, out = gram_size(least_length, least_exponent), []
    for a, b in repeated_stretches(ids, gram):
        w = ids[a:b]
        for d, seeds in squares(w.tolist(), gram).items():
            wanted = max(least_length, least_exponent * d)
            if wanted > b - a:
                continue
            stop = np.flatnonzero(np.concatenate([[True], w[d:] != w[:-d], [True]])) - 1  # places where words d apart differ
            for k in np.unique(np.searchsorted(stop, np.fromiter(seeds, np.int64, len(seeds)) - d)).tolist():
                start, end = int(stop[k - 1]) + 1, int(stop[k]) + d
                if end - start >= wanted and _least_period(w[start:end], d):
                    out.append((a + start, end - start, d))
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def _described(text: str | None, least_length: int, least_exponent: int) -> tuple[list[tuple[int, int, int]], str]:
    words = (text or "").encode("utf-8", "surrogatepass").split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(x, len(seen)) for x in words), np.int64, len(words))
    runs = runs_of(ids, least_length, least_exponent)
    if runs:
        keep = np.ones(len(words), bool)
        for start, length, period in runs:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return runs, b" ".join(words).decode("utf-8", "surrogatepass")


def find_runs(docs: DataFrame, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """(doc_id, runs, collapsed) of every row of docs (doc_id, text): all maximal runs of words, by start, then period, and
    the text's words, joined by one space, less those that a run holds after its first period.

    Words are parted by the six ASCII white-space characters. Null, empty and wordless texts have no runs and
    an empty collapsed text; rows without doc_id and repeated rows are described like others; texts of any length are taken
    whole; an empty table gives no rows. Other columns are not read.
    """

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for a, b in slices(texts):
                rows = [_described(t, least_length, least_exponent) for t in texts[a:b]]
                runs = [[dict(zip(("start", "length", "period"), r)) for r in x[0]] for x in rows]
                yield pa.RecordBatch.from_arrays([ids[a:b], pa.array(runs, kind), pa.array([x[1] for x in rows], pa.string())], ["doc_id", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(describe, f"doc_id long, runs {RUNS}, collapsed string")


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with words that come again where crc32(doc_id) is a multiple of ten: from a word on, the text goes on
    with the same few words over and over. Texts without words, and rows without doc_id, stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.col("text").cast("string"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), h.alias("h"), F.when(h % 10 == 0, words).alias("words"))
    g, n = F.floor(F.col("h") / 10), F.size("words")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(F.col("words"), a + (i - a) % p))
    again = F.array_join(F.concat(F.slice(F.col("words"), F.lit(1), a), tail), " ")
    return rows.select("doc_id", F.when(n > 0, again).otherwise(F.col("text")).alias("text"))


def run_digest(found: DataFrame) -> DataFrame:
    """The result of find_runs as counts, the run of greatest exact exponent (ties: smallest start, then period) and
    checksums of all runs and of the collapsed text."""
    r = lambda x, y: x["length"] * y["period"] - y["length"] * x["period"]

    def order(x: Column, y: Column) -> Column:
        return F.when(r(x, y) > 0, -1).when(r(x, y) < 0, 1).when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0)

    best, lines = F.get(F.array_sort("runs", order), F.lit(0)), F.transform("runs", lambda x: F.concat(x["start"].cast("string"), F.lit(","), x["length"].cast("string"), F.lit(","), x["period"].cast("string"), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
