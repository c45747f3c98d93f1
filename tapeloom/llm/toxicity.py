"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, votes weighted
by distance, neighbours as evidence.

Terms are word stems (whole words and their first 3 to 7 letters) at a density: a stem counts once for each
of four rates that its share of the words reaches. Terms that go with the label in the sample, by a
chi-square test, form the vocabulary. What is learnt comes from a bounded sample of labelled rows and is
bounded by it (max_examples vectors and their terms), so it may be broadcast; scoring is one pass.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .tokens import slices

#: Least share of a text's words that a stem must reach for each level.
RATES = (0.0, 1 / 300, 1 / 100, 1 / 33)
STEMS = (3, 4, 5, 6, 7)
CHI_SQUARE = 30.0
BLOCK, NEIGHBOURS, THRESHOLD = 64, 25, 0.3
_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """True for rows from which no label is learnt."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def stems(word: str) -> list[str]:
    return [word + "$", *(word[:n] for n in STEMS if n <= len(word))]


def levels(count: int, words: int) -> int:
    """Highest level that count of words reaches."""
    rate = count / words
    return max(k for k, r in enumerate(RATES) if rate >= r)


class Examples:
    """Vocabulary, and the examples' vectors as postings in blocks of BLOCK examples with their largest weight."""

    def __init__(self, terms: list[tuple[str, int]]):
        self.term = {t: i for i, t in enumerate(terms)}
        self.stem: dict[str, list[tuple[int, int]]] = {}
        for (s, lv), i in self.term.items():
            self.stem.setdefault(s, []).append((lv, i))
        self.heads = {s[:3] for s in self.stem}
        self.short = {s for s in self.stem if len(s) <= 3}

    def terms_of(self, text: str | None) -> tuple[int, ...]:
        """Sorted vocabulary terms of a whole text."""
        words = _WORD.findall((text or "").lower())
        heads = self.heads
        hits = [w for w in words if w[:3] in heads or (len(w) < 3 and w + "$" in self.stem)]
        if not hits:
            return ()
        count: Counter[str] = Counter()
        for w, n in Counter(hits).items():
            for s in stems(w):
                if s in self.stem:
                    count[s] += n
        out = []
        for s, n in count.items():
            top = levels(n, len(words))
            out += [i for lv, i in self.stem[s] if lv <= top]
        return tuple(sorted(out))

    def index(self, ids: list[int], terms: list[tuple[int, ...]], toxic: list[int]) -> None:
        """Examples with terms are indexed; those without give the rate for texts without."""
        n = len(ids)
        used = [k for k in range(n) if terms[k]]
        bare = [toxic[k] for k in range(n) if not terms[k]]
        self.base = sum(toxic) / max(1, n)
        self.bare = (sum(bare) + self.base) / (len(bare) + 1)
        used.sort(key=lambda k: (terms[k], ids[k]))  # alike ones share blocks, so block bounds are tight
        self.ids = np.array([ids[k] for k in used], np.int64)
        self.toxic = np.array([toxic[k] for k in used], np.float64)
        df = Counter(t for k in used for t in terms[k])
        self.idf = np.array([math.log((1 + n) / (1 + df[t])) + 1 for t in range(len(self.term))])
        self.base = float(self.toxic.mean()) if used else self.base
        blocks = -(-len(used) // BLOCK)
        self.most = np.zeros((len(self.term), blocks))
        postings: list[dict[int, list]] = [{} for _ in range(blocks)]
        for pos, k in enumerate(used):
            t = np.array(terms[k])
            w = self.idf[t] / np.linalg.norm(self.idf[t])
            for i, x in zip(t.tolist(), w.tolist()):
                postings[pos // BLOCK].setdefault(i, []).append((pos % BLOCK, x))
                self.most[i, pos // BLOCK] = max(self.most[i, pos // BLOCK], x)
        self.postings = [{i: (np.array([p for p, _ in l]), np.array([x for _, x in l])) for i, l in block.items()} for block in postings]

    def nearest(self, terms: tuple[int, ...], k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """(positions, cosines) of the k nearest examples, exactly; ties to the smaller doc_id. Blocks are taken by
        falling bound and left once no block's bound reaches the k-th best."""
        t = np.array(terms)
        q = self.idf[t] / np.linalg.norm(self.idf[t])
        bound = q @ self.most[t]
        at, cos = np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or (len(cos) >= k and bound[b] < cos[k - 1] - 1e-12):
                break
            score = np.zeros(BLOCK)
            block = self.postings[b]
            for i, x in zip(terms, q.tolist()):
                if i in block:
                    p, w = block[i]
                    score[p] += x * w
            p = np.flatnonzero(score)
            at, cos = np.concatenate([at, p + b * BLOCK]), np.concatenate([cos, score[p]])
            order = np.lexsort((self.ids[at], -np.round(cos, 12)))[:k]
            at, cos = at[order], cos[order]
        return at, np.minimum(cos, 1.0)

    def score(self, terms: tuple[int, ...]) -> tuple[float, list[int], list[float]]:
        """(share of toxic votes, neighbours' doc_ids, cosines)."""
        if not terms or not len(self.ids):
            return self.bare, [], []
        at, cos = self.nearest(terms)
        if not len(at):
            return self.bare, [], []
        vote = 1 / (1.1 - cos)
        return float((vote @ self.toxic[at] + self.base) / (vote.sum() + 1)), self.ids[at].tolist(), cos.tolist()


def sample_labels(docs: DataFrame, labels: DataFrame, max_examples: int) -> DataFrame:
    """(doc_id, text, toxic) of at most max_examples labelled documents that are not held out, by hash."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    one = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    few = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    # at most max_examples rows are broadcast; of rows of one doc_id the greatest text counts, so the bound holds
    found = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id").groupBy("doc_id", "toxic").agg(F.max("text").alias("text"))
    return materialize(found.select("doc_id", "text", "toxic"), "examples")


def learn(sample: DataFrame) -> Examples:
    """Vocabulary by chi-square over the sample, then the examples' vectors."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                words = _WORD.findall((text or "").lower())
                of: Counter[str] = Counter()
                for w, n in Counter(words).items():
                    for s in stems(w):
                        of[s] += n
                names = list(of)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([levels(of[s], len(words)) for s in names], pa.int32()), pa.array([toxic] * len(names), pa.int32())], ["stem", "level", "toxic"])

    totals = sample.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    n, nt = int(totals[0] or 0), int(totals[1] or 0)
    nc = n - nt
    seen = sample.select("text", "toxic").mapInArrow(count, "stem string, level int, toxic int").groupBy("stem").agg(*[F.sum(F.when(F.col("level") >= k, F.col("toxic"))).alias(f"t{k}") for k in range(len(RATES))], *[F.sum(F.when(F.col("level") >= k, 1 - F.col("toxic"))).alias(f"c{k}") for k in range(len(RATES))])
    flat = seen.select("stem", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.coalesce(f"t{k}", F.lit(0)).alias("a"), F.coalesce(f"c{k}", F.lit(0)).alias("b")) for k in range(len(RATES))])).alias("x")).select("stem", "x.*")
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    gap = F.greatest(F.lit(0.0), F.abs(a * (nc - b) - b * (nt - a)) - F.lit(n / 2))
    chi = n * gap * gap / (F.lit(float(nt)) * F.lit(float(nc)) * (a + b) * (n - a - b))
    rated = flat.where((a + b >= 3) & (a + b < n) & (a * nc > b * nt)).withColumn("chi", chi).where(F.col("chi") >= CHI_SQUARE)
    model = Examples([(r[0], r[1]) for r in rated.orderBy(F.col("chi").desc(), "stem", "level").select("stem", "level").collect()] if nt and nc else [])

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [model.terms_of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array([list(t) for t in terms], pa.list_(pa.int32()))], ["doc_id", "toxic", "terms"])

    rows = sample.select(F.col("doc_id").cast("long"), "toxic", "text").mapInArrow(vectors, "doc_id long, toxic int, terms array<int>").orderBy("doc_id").collect()
    model.index([r[0] for r in rows], [tuple(r[2]) for r in rows], [r[1] for r in rows])
    return model


def score_documents(docs: DataFrame, labels: DataFrame, max_examples: int = 4096) -> DataFrame:
    """docs with held_out, score, predicted, evidence (doc_ids of the nearest examples) and their cosines.

    The score depends on the text alone. Null and empty texts, and texts without a vocabulary term, get the
    rate of examples without one. Without labels of both kinds there is no vocabulary and all get that
    rate. Very long texts are scored whole. Rows repeat as in docs; an empty table gives none; columns of docs stay, but for those named
    like the new ones.
    """
    model = learn(sample_labels(docs, labels, max_examples))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, ...], tuple] = {}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices(texts):
                found = []
                for t in texts[a:b]:
                    terms = held.value.terms_of(t)
                    if terms not in known:
                        if len(known) > 50_000:
                            known.clear()
                        known[terms] = held.value.score(terms)
                    found.append(known[terms])
                part = batch.slice(a, b - a)
                new = [pa.array([f[0] for f in found], pa.float64()), pa.array([f[1] for f in found], pa.list_(pa.int64())), pa.array([f[2] for f in found], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*part.schema.names, "score", "evidence", "cosine"])

    kept = docs.drop("held_out", "score", "predicted", "evidence", "cosine").withColumn("text", F.col("text").cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", score double, evidence array<bigint>, cosine array<double>"
    scored = kept.mapInArrow(rate, schema)
    return scored.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
