"""Spelling variants, MinHash groups and periodic runs against brute force and on the awkward tables."""

import hashlib
import itertools
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import minhash, periodic_runs, shingles, spelling
from tapeloom.llm.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
WORDS = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrs"]
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def text_of(rng, n):
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DIR}/documents.parquet'")
    return con


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_minhash_dedup"])
def test_query_equals_sql(spark, db, name):
    got, rel = QUERIES[name](spark, DIR), db.sql(SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(rel.columns)
    want = Counter(tuple(r[rel.columns.index(c)] for c in columns) for r in rel.fetchall())
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == want and len(want) > 10


# ---- spelling


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


@pytest.mark.parametrize("group", [spelling.GROUP, 1])
def test_near_pairs_equal_all_pairs(spark, group):
    rng = np.random.default_rng(1)
    words = {"".join(rng.choice(list("abcéÀß"), rng.integers(4, 9))) for _ in range(1200)} | {"aaaaa", "aaaaaa", "aabaa", "aaaaaaa", "ababa", "babab", "ababab"}
    df = spark.createDataFrame([(w, k) for k, w in enumerate(sorted(words))], "word string, n long")
    got = [frozenset((r.a, r.b)) for r in spelling.near_pairs(df, group).collect()]
    want = {frozenset(p) for p in itertools.combinations(words, 2) if near(*p)}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200


def test_parity_masks_flip_two_bits_at_most(spark):
    assert sorted("".join(spelling.BANDS)) == sorted({*map(chr, range(97, 123)), *map(chr, range(0xC0, 0x100))}) and max(map(len, spelling.BANDS)) <= 31
    df = spark.createDataFrame([("letter",), ("lettre",), ("lettér",), ("leter",), ("xé",)], "w string")
    rows = [sum(bin(m).count("1") << (8 * k) for k, m in enumerate(r)) for r in df.select(*[spelling.parity_mask(F.col("w"), b) for b in spelling.BANDS]).collect()]
    assert rows[0] == rows[1] and all(r >= 0 for r in rows)


def test_forms_ties_chains_and_awkward_texts(spark):
    texts = [(1, "colour " * 12 + "color " * 6 + "colr " * 3 + "zzzzz zzzzz zzzzz Stone STONE stone stony stony stony stons stons stons"), (2, None), (3, ""), (None, "abc abcd naïve Naïve naïve NAïVE"), (4, "x" * 5000 + " " + "x" * 5000), (4, "x" * 5000)]
    docs = spark.createDataFrame([(*t, 0, 0) for t in texts], "doc_id long, text string, word int, n int")
    words = spelling.observed_words(docs, damage=None)
    assert {r.word: r.n for r in words.collect()} == {"colour": 12, "color": 6, "zzzzz": 3, "stone": 3, "stony": 3, "stons": 3, "naïve": 4, "x" * 5000: 3}
    pairs = {frozenset((r.a, r.b)) for r in spelling.near_pairs(words).collect()}
    assert pairs == {frozenset(p) for p in [("colour", "color"), ("stone", "stony"), ("stone", "stons"), ("stony", "stons")]}
    rows = [(7, " ".join(["aaaaa"] * 3 + ["aaaab"] * 6 + ["aaabb"] * 12 + ["aacbb"] * 24 + ["aaaac"] * 6))]
    out = {r.word: r for r in spelling.variant_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n = {w: out[w].n for w in out}
    for w, r in out.items():
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form = best if best and n[best] >= 2 * n[w] else None
        assert (r.form, r.form_n, r.n_near) == (form, n.get(form), len(others))
        while form:
            w, form = form, out[form].form
        assert r.root == w
    assert spelling.variant_groups(docs.limit(0)).count() == 0


def test_damage_follows_the_checksum(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), " ".join("Éa" + WORDS[k] + WORDS[j] for k, j in rng.integers(0, 125, (40, 2)))) for i in range(60)]
    want = Counter()
    for i, t in rows:
        for run in t.split():
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            want[run] += len(run) >= 5
    got = {r.word: r.n for r in spelling.observed_words(spark.createDataFrame(rows, "doc_id long, text string"), least_count=1).collect()}
    assert got == dict(want)


# ---- MinHash


def groups_of(rows):
    sets = [(i, set() if not (w := SPACE.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))) else {" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))}) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, a), (j, b) in itertools.combinations([x for x in sets if x[0] is not None and x[1]], 2):
        if 100 * len(a & b) >= 85 * len(a | b):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return Counter((i, len(s), None if i is None else root(i), None if i is None else root(i) == i) for i, s in sets)


def edited(rng, text, edits):
    w = text.split()
    for k in rng.integers(0, len(w), edits):
        w[k] = WORDS[rng.integers(0, len(WORDS))]
    return " ".join(w)


@pytest.mark.parametrize("tile", [minhash.TILE, 16])
def test_groups_equal_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(minhash, "TILE", tile)
    rng = np.random.default_rng(5)
    rows = []
    for size, edits in ((200, 3), (60, 2), (12, 1), (400, 12)):  # chains around the threshold, not only stars
        base = text_of(rng, size)
        for _ in range(40):
            rows.append(edited(rng, base, int(rng.integers(0, edits + 1))))
            if rng.random() < 0.4:
                base = edited(rng, base, 2)
    rows = [(int(k), t) for k, t in enumerate(rows)] + [(300 + k, text_of(rng, 80)) for k in range(40)]
    base = text_of(rng, 50)
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one two"), (1004, "ONE  two"), (1005, "one"), (None, base), (1006, base), (1006, text_of(rng, 30)), (1007, base.upper()), (1007, base.upper()), (1008, text_of(rng, 20_000))]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, z string").repartition(5)
    got = Counter(tuple(r) for r in minhash.near_groups(docs).collect())
    assert got == groups_of(rows)
    assert minhash.near_groups(docs.limit(0)).count() == 0


def test_batches_drop_links_as_rarely_as_chosen():
    """Signatures agree as often as the sets are alike; pairs at the threshold pass all batches, unlike ones few."""
    rng, least = np.random.default_rng(7), minhash.least_equal()
    assert least == sorted(least) and len(least) == minhash.BATCHES
    for alike, passed in ((0.85, 1.0), (0.95, 1.0), (0.3, 0.0)):
        sets, n = [], 400
        both = round(2 * n * alike / (1 + alike))
        for _ in range(300):
            x = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
            sets += [np.sort(x[:n]), np.sort(x[n - both :])]
        ids, keys, marks = minhash.signatures(sets)
        assert [tuple(i) for i in ids[:20].tolist()] == [minhash.signatures_id(s) for s in sets[:20]]
        x, y = marks[0::2], marks[1::2]
        assert abs((x == y).mean() - (alike + (1 - alike) / 256)) < 0.01
        assert abs(len(minhash._alive(x, y, least)) / len(x) - passed) < 0.01
        meet = (keys[0::2] == keys[1::2]).mean()
        assert abs(meet - alike**minhash.ROWS) < 0.03


def test_shingle_size():
    one, two, five = (len(shingles.shingle_sets(["a b c d e"], k)[0]) for k in (1, 2, 5))
    assert (one, two, five) == (5, 4, 1)


# ---- periodic runs


def all_runs(w, least=24, exponent=3):
    out, n = [], len(w)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length, seg = j + q - i, w[i : j + q]
            if length >= max(least, exponent * q) and not any(seg[k:] == seg[:-k] for k in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least, exponent", [(24, 3), (6, 2), (10, 4)])
def test_runs_equal_brute_force(least, exponent):
    rng, found = np.random.default_rng(11), 0
    for k in range(600):
        if k % 4 == 0:
            w = rng.integers(0, 2, rng.integers(0, 120))
        elif k % 4 == 1:
            w = np.concatenate([np.tile(rng.integers(0, 3, rng.integers(1, 12)), rng.integers(1, 9)) for _ in range(4)])
        elif k % 4 == 2:
            w = np.concatenate([np.tile(np.tile(rng.integers(0, 2, 3), 4), rng.integers(1, 4)) for _ in range(3)] + [rng.integers(0, 2, 5)])
        else:
            a, b = [0], [0, 1]
            while len(b) < 200:
                a, b = b, b + a
            w = np.array(b[: rng.integers(20, 200)])
        want = all_runs(w.tolist(), least, exponent)
        assert periodic_runs.runs_of(w.astype(np.int64), least, exponent) == want
        found += len(want)
    assert found > 100


def test_end_positions_of_the_automaton():
    word = [0, 1, 0, 1, 0, 2, 0, 1, 0]
    link, size, first = periodic_runs.automaton(word)
    assert len({tuple(word[i:j]) for i in range(9) for j in range(i + 1, 10)}) == sum(size[v] - size[link[v]] for v in range(1, len(size)))
    assert sorted(f for f in first if f >= 0) == list(range(9))
    assert periodic_runs.squares([0, 1] * 4, 1)[2] and 4 not in periodic_runs.squares([5, 6, 7, 8], 1)


def digest(i, text, planted):
    w = SPACE.findall(text or "")
    n, h = len(w), 1 if i is None else zlib.crc32(str(i).encode())
    if planted and h % 10 == 0 and n:
        g = h // 10
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = all_runs(w)
    keep = [True] * n
    for s, length, q in runs:
        keep[s + q : s + length] = [False] * (length - q)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (i, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for x, k in zip(w, keep) if k)))


def test_run_digest_equals_brute_force(spark):
    rng = np.random.default_rng(13)
    rows = [(int(i), text_of(rng, int(rng.integers(1, 150)))) for i in range(250)]
    line = text_of(rng, 9)
    rows += [(900, None), (901, ""), (902, "\t \n"), (None, "a b " * 20), (903, "A a " * 20), (904, "\n".join([line] * 4 + [text_of(rng, 5)] + [line] * 3)), (904, "x " * 24), (904, "x " * 24), (905, "x " * 23), (906, "ä b c " * 3000), (907, "a b " * 12 + "c d e " * 8)]
    docs = spark.createDataFrame([(*r, 0, 0) for r in rows], "doc_id long, text string, runs int, h int")
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    for planted in (True, False):
        got = periodic_runs.run_digest(periodic_runs.find_runs(periodic_runs.with_repeats(docs) if planted else docs))
        assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(digest(i, t, planted) for i, t in rows)
    assert periodic_runs.find_runs(docs.limit(0)).count() == 0
    again = periodic_runs.find_runs(docs.where("doc_id = 904")).orderBy(F.length("collapsed")).collect()
    assert again[0].collapsed == "x" and [tuple(r) for r in again[0].runs] == [(0, 24, 1)] and len(again[2].runs) == 2
