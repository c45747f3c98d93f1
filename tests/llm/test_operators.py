"""Each operator against brute force and on the awkward tables: nulls, empty and long texts, ties, repeated rows, no rows,
clashing column names."""

import html as html_module
import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tapeloom.llm import ann, common, html_extract, jaccard_join, line_dedup, mixing, packing, sharding, shingles, token_files, tokens, topk, toxicity

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
WORDS = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrs"]


def text_of(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


def awkward(spark, clash=("shard", "part", "h")):
    """doc_id, text, source, and columns that clash with names used inside."""
    base = text_of(1, 60)
    rows = [(1, base), (2, base), (2, base), (3, None), (4, ""), (None, text_of(2, 30)), (5, "one two"), (6, base.replace(" ", "  ", 1)), (7, text_of(3, 3000)), (8, "naïve Čaj 中文 x\ty\n\nz"), (9, base + " tail"), (9, text_of(4, 12)), (10, text_of(5, 40) + "\n" + base)]
    rows = [(i, t, None if k % 4 == 0 else f"s{k % 3}", *[k] * len(clash)) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in clash))


@pytest.fixture(scope="module")
def docs(spark):
    return awkward(spark, ("shard", "part", "h", "node", "n", "cell", "key", "size", "ids", "start", "doc", "gone", "all", "score", "held_out", "n_lines", "bits")).cache()


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()


def test_shards_are_minimax(spark, docs):
    rng = np.random.default_rng(3)
    rows = [(i, "x" * int(s)) for i, s in enumerate(rng.integers(0, 400, 300))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sharding.shard_documents(df, 7).collect()
    by_text = defaultdict(set)
    for r in out:
        by_text[r.text_crc32].add(r.shard)
        assert r.text_crc32 == zlib.crc32(rows[r.doc_id][1].encode()) and r.size == len(rows[r.doc_id][1]) + 8
    assert all(len(s) == 1 for s in by_text.values())
    groups = [(r.h, r.bytes) for r in df.select(F.xxhash64("text").alias("h"), (F.octet_length("text") + 8).alias("s")).groupBy("h").agg(F.sum("s").alias("bytes")).collect()]
    sizes = [b for _, b in sorted(groups)]

    def fits(cap):
        shards, room = 1, cap
        for s in sizes:
            if s > room:
                shards, room = shards + 1, cap
            room -= s
        return shards <= 7

    least = next(c for c in range(max(max(sizes), -(-sum(sizes) // 7)), sum(sizes) + 1) if fits(c))
    held = Counter()
    for r in out:
        held[r.shard] += r.size
    assert max(held.values()) <= least
    for s in held:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert sharding.shard_documents(docs, 24).count() == docs.count()
    assert sharding.shard_documents(docs.limit(0), 24).count() == 0


def test_block_refinement_reaches_group_level(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FIRST_BITS", 3)
    rng = np.random.default_rng(5)
    keys = rng.integers(-(1 << 63), 1 << 63, 200, dtype=np.int64)
    sizes = rng.integers(1, 1000, 200)
    g = spark.createDataFrame([(int(k), int(s)) for k, s in zip(keys, sizes)], "h long, bytes long")
    cap, cuts = sharding.plan_cuts(g, 5)
    order = np.argsort(keys)
    parts = np.array_split(np.arange(200), 1)
    shard = np.searchsorted(np.array(cuts, np.int64), keys, "right")
    assert max(sizes[shard == s].sum() for s in range(5)) <= cap and len(parts) == 1

    def fits(c):
        n, room = 1, c
        for s in sizes[order]:
            if s > room:
                n, room = n + 1, c
            room -= s
        return n <= 5

    assert fits(cap) and not fits(cap - 1)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_equals_tokenizer(path, real):
    t = Tokenizer.from_file(path)
    texts = [r.text for r in real.select("text").collect()] + ["a  b", " a", "a\t b", "x\n\ny", "x \ny", "don't I'll 12 3's", "É é ñ Σας İx", "<|endoftext|> a", "中文 字", "a b", "!!a!! b_c 1a2", "\x1ca b", "é x", "\n", " ", "a", "ŉx Ǆab"]
    got = tokens.Encoder(path).encode(texts + [None, ""])
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [t.encode(x, add_special_tokens=False).ids for x in texts] + [[], []]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder_fuzz(path, monkeypatch):
    """Marks, combining characters, odd letters and every kind of white space, with a small memory."""
    monkeypatch.setattr(tokens, "REMEMBER", 20_000)
    rng = np.random.default_rng(8)
    letters = list("abcdefgXYZ") + list("\u0130\u0131\u00df\u00e9\u0301\u0307\u01c4\u0149\u03a3\u03c2\u4e2d\u0e01\u1e9e\ufb01\u200d") + list("0123.,!?'-_()<|>") + [" "] * 6 + list("\n\t\r\x0b\x1c\x85\xa0\u2003\u3000")
    texts = ["".join(rng.choice(letters, rng.integers(1, 14))) for _ in range(50_000)] + ["B\u0130. M\u0130!"]
    t = Tokenizer.from_file(path)
    got = tokens.Encoder(path).encode(texts)
    want = [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert [i for i, (g, w) in enumerate(zip(got, want)) if np.frombuffer(g, "<u4").tolist() != w] == []


def test_packed_pieces_equal_tokenizer(spark, docs):
    """Every piece's ids and checksum against the tokenizer's own ids, and buckets of one length."""
    t = Tokenizer.from_file(BYTE)
    one = docs.select("doc_id", "text").where("doc_id is not null").dropDuplicates(["doc_id"])
    want = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [0] for r in one.collect()}
    packed = common.materialize(packing.pack_documents(one, BYTE, longest=64), "test-packed")
    crc = {r.sequence_id: r.ids_crc32 for r in packing.packed_digest(packed).collect()}
    seen = Counter()
    for r in packed.collect():
        ids = np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert r.ids == ids and crc[r.sequence_id] == zlib.crc32(ids) and r.doc_tokens == len(want[r.doc_id]) and 1 << r.bucket == r.length
        seen[r.doc_id] += r.length
    assert seen == {k: len(v) for k, v in want.items()}
    path = common.new_path(spark, "test-buckets")
    packing.write_buckets(packed, path)
    assert {r.length for r in spark.read.parquet(f"{path}/bucket=5").collect()} == {32}
    with pytest.raises(ValueError):
        packing.pack_documents(docs, BYTE, longest=1 << 16)


def test_token_files_seek(spark, docs, monkeypatch):
    t = Tokenizer.from_file(WORD)
    path = common.new_path(spark, "test-seek")
    token_files.write_token_files(docs, path, WORD)
    some = docs.where("doc_id % 3 = 0").select("doc_id")
    want = Counter((r.doc_id, tuple((t.encode(r.text or "", add_special_tokens=False).ids + [1])[5:205])) for r in docs.where("doc_id % 3 = 0").collect())
    got = token_files.read_documents(spark, path, some, 5, 200).collect()
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 1 << 20, 1000, dtype=np.uint64).astype(np.uint32)
    data = token_files.pack_ids(ids)
    for start, count in ((0, 1000), (127, 2), (128, 128), (990, 50), (1000, 5), (3, 0)):
        assert token_files.read_ids(data, start, count).tolist() == ids[start : start + count].tolist()


def test_packing_covers_every_id_once(docs):
    t = Tokenizer.from_file(BYTE)
    want = Counter()
    for r in docs.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [0]
        want[r.doc_id, tuple(ids)] += 1
    got = defaultdict(list)
    rows = packing.pack_documents(docs.select("doc_id", "text"), BYTE).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    for r in rows:
        assert r.length & (r.length - 1) == 0 and r.length <= 1024 and r.offset == 0
        got[r.doc_id, r.doc_tokens].append((r.start, r.ids))
    total = Counter()
    for (doc, n), parts in got.items():
        copies = sum(v for (d, ids), v in want.items() if d == doc and len(ids) == n)
        assert sum(len(p) // 4 for _, p in parts) == copies * n
        total[doc] += copies
    assert total == Counter(r.doc_id for r in docs.collect())
    assert packing.pack_documents(docs.select("doc_id", "text").limit(0), BYTE).count() == 0
    assert packing.pieces(1024 * 2 + 7, 1024) == [(0, 1024), (1024, 1024), (2048, 4), (2052, 2), (2054, 1)]


def test_token_files_round_trip(spark, docs):
    t = Tokenizer.from_file(WORD)
    path = common.new_path(spark, "test-files")
    token_files.write_token_files(docs, path, WORD)
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    start = 0
    want = Counter((r.doc_id, tuple(t.encode(r.text or "", add_special_tokens=False).ids + [1])) for r in rows)
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in got) == want
    empty = common.new_path(spark, "test-files")
    token_files.write_token_files(docs.limit(0), empty, WORD)
    assert token_files.read_token_files(spark, empty, digest=True).count() == 0


@pytest.mark.parametrize("top", [1, 2, 300, 70_000, 1 << 31, (1 << 32) - 1])
@pytest.mark.parametrize("n", [0, 1, 127, 128, 1000])
def test_blocks_round_trip(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
    ids[rng.random(n) < 0.05] //= 100
    assert (token_files.unpack_ids(token_files.pack_ids(ids)) == ids).all()


def test_mixing_meets_targets(spark, docs):
    rows = [(i, text_of(i, 1 + i % 50), f"s{i % 5}" if i % 7 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_sources(df).collect()
    again = mixing.mix_sources(df.repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)
    size, taken, target = Counter(), Counter(), {}
    for r in out:
        assert r.taken <= 2 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    want, left, weights = {}, 1.5 * sum(size.values()), dict(zip(sorted((s for s in size if s is not None)) + [None], itertools.cycle((5, 2, 1))))
    open_ = dict(weights)
    while True:
        share = {s: left * w / sum(open_.values()) for s, w in open_.items()}
        over = [s for s in open_ if share[s] >= 2 * size[s]]
        if not over:
            break
        for s in over:
            want[s] = 2.0 * size[s]
            left -= want[s]
            del open_[s]
    want |= share
    assert all(math.isclose(target[s], want[s]) and abs(taken[s] - target[s]) <= 1 for s in size)
    assert mixing.mix_sources(docs).count() == docs.count() and mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.mixed_documents(docs).columns == docs.columns


def brute_groups(rows):
    """doc_id to smallest doc_id over links, by all pairs."""
    sets = defaultdict(list)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        s = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
        if i is not None and s:
            sets[i].append(s)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets.items(), 2):
        if any(100 * len(x & y) >= 75 * len(x | y) for x in a for y in b):
            a_, b_ = sorted((find(i), find(j)))
            root[b_] = a_
    return {i: find(i) for i in sets}


def test_jaccard_groups_equal_all_pairs(spark, docs):
    rng = np.random.default_rng(11)
    rows, n = [], 0
    for g in range(6):
        words = text_of(100 + g, 80).split()
        for _ in range(14):
            w = list(words)
            for _ in range(rng.integers(0, 6)):
                w[rng.integers(0, len(w))] = WORDS[rng.integers(0, len(WORDS))]
            rows.append((n, " ".join(w[: len(w) - int(rng.integers(0, 12))])))
            n += 1
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    all_rows = [tuple(r) for r in df.collect()]
    want = brute_groups(all_rows)
    out = jaccard_join.jaccard_groups(df).collect()
    assert len(out) == len(all_rows)
    for r in out:
        assert r.component_id == (want.get(r.doc_id, r.doc_id) if r.doc_id is not None else None)
    assert jaccard_join.jaccard_groups(df.limit(0)).count() == 0


def test_jaccard_tiles_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 3)
    rows = []
    passage = text_of(500, 30)
    for g in range(8):
        body = text_of(600 + g, 12)
        rows += [(g * 10 + k, f"{passage} {body} {text_of(700 + g, k)}") for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_groups(rows)
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_groups(df).collect()} == want


def test_shingles_of_short_texts():
    a, b, c, d = shingles.shingle_sets(["A b c", "a B  c", "a b c d", " \n"])
    assert a == b and a != c and len(a) == len(c) == 1 and len(d) == 0


def test_components(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in common.connected_components(chain).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100}
    assert common.connected_components(chain.limit(0)).count() == 0


def test_lines(spark, docs):
    long = text_of(7, 300)
    near = long.split()
    near[150] = "zzz"
    line = text_of(8, 12)
    rows = [(3, f"{line}\nkeep this here line\n\nhi"), (1, f"{line.upper()}!\nfirst of all lines"), (2, long), (4, " ".join(near)), (5, None), (6, ""), (None, line), (7, "hi\nhi")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("n_lines", F.lit("x"))
    out = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert out[1].text == rows[1][1] and out[3].text == "keep this here line\n\nhi" and out[3].n_removed == 1 and out[3].n_lines == 4
    assert out[2].text == long and out[4].text == "" and out[4].n_removed == 1
    assert out[5].text is None and out[6].text == "" and out[None].text == "" and out[7].text == "" and out[7].n_removed == 2
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(df, min_words=3).collect()}
    assert kept[7] == "hi\nhi" and kept[4] == ""
    assert line_dedup.dedup_lines(docs).count() == docs.count() and line_dedup.dedup_lines(docs.limit(0)).count() == 0


def line_near(a, b):
    """Brute force: edit similarity of 0.9, in characters where the longer line has under LONG words."""
    n = max(len(a.split()), len(b.split()))
    if min(len(a.split()), len(b.split())) < line_dedup.FUZZY_WORDS:
        return a == b
    x, y = (a.split(), b.split()) if n >= line_dedup.LONG else (a, b)
    longer = max(len(x), len(y))
    return abs(len(x) - len(y)) * 10 <= longer and edit_similarity(x, y) >= 0.9 - 1e-9


def test_lines_against_all_pairs(spark):
    """Planted edits of a letter, a word, and a tenth of the words: all found, and no line more than all pairs link."""
    import random

    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    rows, planted = [], []
    for n in (3, 5, 9, 10, 12, 20, 31, 32, 33, 40, 60):
        for kind in range(3):
            for _ in range(6):
                words = [rng.choice(vocabulary) for _ in range(n)]
                new = list(words)
                if kind == 0:
                    i = rng.randrange(n)
                    new[i] = new[i][:-1] + "q"
                else:
                    for i in rng.sample(range(n), 1 if kind == 1 else max(1, n // 10)):
                        new[i] = rng.choice(vocabulary)
                planted.append((len(rows), len(rows) + 1))
                rows += [" ".join(words), " ".join(new)]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if abs(len(rows[i]) - len(rows[j])) < 60 and len({*rows[i].split()} & {*rows[j].split()}) * 3 >= len(rows[i].split()) - 3 and line_near(rows[i], rows[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    want = {i for i in range(len(rows)) if root(i) != i}
    assert len(want) > len(planted) / 2
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = line_dedup.dedup_lines(df).collect()
    assert {r.doc_id for r in out if r.n_removed} == want
    assert all(r.text == ("" if r.doc_id in want else rows[r.doc_id]) for r in out)


def test_lines_of_numbers_marks_and_unspaced_scripts(spark):
    thai = "\u0e01\u0e02\u0e03\u0e04\u0e05\u0e06\u0e07\u0e08\u0e09\u0e0a\u0e0b\u0e0c\u0e0d\u0e0e\u0e0f\u0e10\u0e11\u0e12\u0e13\u0e14"
    rows = [(1, "invoice 1001 is 25 dollars"), (2, "invoice 2002 is 99 dollars"), (3, thai), (4, thai[:7] + "\u0e2e" + thai[8:]), (5, "Odd -- marks, here!"), (6, "odd marks (here)"), (7, "***"), (8, "***\n***"), (9, "odd \u2014 marks here\u2026")]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k for k, r in out.items() if r.n_removed} == {4, 6, 9}
    assert out[8].text == "***\n***"


def test_pages(spark):
    sample = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    body = "".join(f"<p>Paragraph {k} with {k} words, and some more of them to read.</p>" for k in range(6))
    html = f"<html><head><title>T</title><script>var x='<p>no</p>'</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>Head &amp; line</h1>{body}<p>open <b>bold<br>x</article><div class=ad>Buy</div><footer>Foot</footer>"
    rows = sample.select("page_id", "url", "html").union(spark.createDataFrame([(-1, "u", html), (-2, None, None), (-3, "u", ""), (-3, "u", "<p cla")], "page_id long, url string, html string")).withColumn("text", F.lit("clash"))
    out = defaultdict(list)
    for r in html_extract.extract_main_text(rows).collect():
        assert r.n_chars == len(r.text)
        out[r.page_id].append(r.text)
    assert out[-1] == ["Head & line\n" + "\n".join(f"Paragraph {k} with {k} words, and some more of them to read." for k in range(6)) + "\nopen bold x"]
    assert out[-2] == [""] and out[-3] == ["", ""]
    for r in sample.collect():  # the article's blocks, taken out by patterns
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        parts = [" ".join(html_module.unescape(re.sub(r"</?[bi]>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", inner)]
        assert out[r.page_id] == ["\n".join(p for p in parts if p)]
    assert html_extract.extract_main_text(rows.limit(0)).count() == 0


def test_pages_without_marks_or_end_tags(spark):
    sample = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    body = "".join(f"<p>Paragraph {k} of the text has {k} words, and some more of them to read on.</p>" for k in range(8))
    want = "\n".join(f"Paragraph {k} of the text has {k} words, and some more of them to read on." for k in range(8))
    long = "".join(f"<p>Line {k} of a very long page, with enough words to be text.</p>" for k in range(3000))
    rows = [
        (-1, f"<html><head><title>T</title><body><article>{body}</article></body></html>"),
        (-2, f"<html><head><meta charset=utf-8><article>{body}</article>"),
        (-3, "<html><body><nav><a href=/>Home</a><a href=/b>More</a></nav><article><p>Short.</p></article><footer>Foot</footer></body></html>"),
        (-4, f"<html><body><article>{long}</article></body></html>"),
    ]
    given = sample.union(spark.createDataFrame([(i, "u", h) for i, h in rows], "page_id long, url string, html string"))
    out = {r.page_id: r.text for r in html_extract.extract_main_text(given).where("page_id < 0").collect()}
    assert out[-1] == want and out[-2] == want and out[-3] == "Short." and out[-4].count("\n") == 2999


def test_toxicity_held_out(spark, docs):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    out = toxicity.score_documents(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    hit = [r.toxic for r in out if r.predicted == 1]
    assert sum(hit) / len(hit) >= 0.75 and sum(hit) / sum(r.toxic for r in out) >= 0.6
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    none = toxicity.score_documents(docs, labels.limit(0)).collect()
    assert len(none) == docs.count() and len({r.score for r in none}) == 1
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0


def test_block_max_is_exact():
    rng = np.random.default_rng(2)
    model = toxicity.Examples([(f"t{k}", 0) for k in range(40)])
    terms = [tuple(sorted(rng.choice(40, rng.integers(1, 8), replace=False).tolist())) for _ in range(500)]
    model.index(list(range(500)), terms, rng.integers(0, 2, 500).tolist())
    unit = lambda t: np.bincount(t, model.idf[list(t)], 40) / np.linalg.norm(model.idf[list(t)])
    m = np.array([unit(terms[i]) for i in model.ids])
    for q in terms[:50]:
        cos = m @ unit(q)
        want = np.lexsort((model.ids, -np.round(cos, 12)))[:25]
        got, score = model.nearest(q)
        n = int((cos[want] > 0).sum())
        assert model.ids[got][:n].tolist() == model.ids[want][:n].tolist() and np.allclose(score[:n], cos[want][:n])


def vectors(spark, n=700, dim=16, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[200:400] = x[100]  # a third of the rows are one vector
    rows = [(i, x[i].tolist(), 0) for i in range(n)] + [(n, None, 0), (n + 100, [0.0] * dim, 0), (n + 200, [float("nan")] * dim, 0), (n + 300, [None] * dim, 0), (n + 400, [float("inf")] * dim, 0), (100, x[100].tolist(), 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard int"), x.astype(np.float64)


def test_nearest_recall_and_ties(spark):
    df, x = vectors(spark)
    out = defaultdict(list)
    for r in ann.nearest(df, shard_rows=200).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.vec_id, r.score))
    assert set(out) == set(range(0, 700, 100))
    hit = 0
    for q, got in out.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want = np.lexsort((np.arange(700), d))[:10]
        hit += len(set(want) & {v for v, _ in got})
        assert all(math.isclose(s, d[v], abs_tol=1e-12) for v, s in got) and len(got) == 10
    assert hit >= 0.9 * 10 * len(out)
    assert [v for v, _ in out[300]] == [100, *range(200, 209)]
    assert ann.nearest(df.limit(0)).count() == 0 and ann.nearest(df.where("vec_id in (0, 1)")).count() == 1


@pytest.mark.parametrize("shape", ["offset", "far clusters", "near copies", "large"])
def test_graph_recall_on_shapes(shape):
    """Recall of one shard's graph against brute force where differences are small beside the components."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 24))
    if shape == "offset":
        x += 1e4
    elif shape == "far clusters":
        x += rng.integers(-3, 4, (1500, 1)) * 1e5
    elif shape == "near copies":
        x = x[rng.integers(0, 100, 1500)] + rng.normal(size=x.shape) * 1e-3
    else:
        x *= 1e30
    graph, hit = ann.Graph.build(x), 0
    for q in range(0, 1500, 50):
        want = np.argsort(((x - x[q]) ** 2).sum(axis=1), kind="stable")[:10]
        hit += len(set(want.tolist()) & set(graph.search(x[q]).tolist()))
    assert hit >= 0.9 * 10 * 30


def test_top_products_equal_brute_force(spark):
    df, x = vectors(spark)
    z = np.vstack([np.floor(256 * x), np.zeros((101, 16))])
    ids = [*range(700), 800]
    got = defaultdict(list)
    for r in topk.top_products(df, shard_rows=300).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == {i for i in ids if i % 50 == 0}
    for q, found in got.items():
        s = z[[*range(700), 700]] @ z[min(q, 700)]
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:5]
        assert found == [(ids[k], int(s[k])) for k in order]
    assert topk.top_products(df.limit(0)).count() == 0


def test_lists_stop_early():
    rng = np.random.default_rng(0)
    x = np.floor(rng.normal(size=(2000, 4)) * 50)
    rows, score, read = topk.read_lists(topk.lists_of(x), x[3], 6)
    want = np.sort(x @ x[3])[::-1][:6]
    assert read < x.size / 2 and np.sort(score)[::-1][:6].tolist() == want.tolist() and score.tolist() == (x[rows] @ x[3]).tolist()
    for q in (x[3] * [1, 0, -1, 0], x[9] * 0, -x[7]):
        for n in (3, 64, 2000):
            rows, score, _ = topk.read_lists(topk.lists_of(x[:n]), q, 6)
            every = x[:n] @ q
            assert score.tolist() == every[rows].tolist() and set(np.flatnonzero(every >= np.sort(every)[-6:][0])) <= set(rows.tolist())


def test_lists_of_a_block_of_queries():
    """A block of queries at once gives what each gives alone, with and without a floor, of few and many dimensions."""
    rng = np.random.default_rng(5)
    for n, d in ((2000, 4), (900, 32), (5, 3), (1, 2)):
        x = np.floor(rng.normal(size=(n, d)) * 50)
        qs = np.vstack([x[:40], -x[:3], np.zeros((1, d))])
        for floors in (np.full(len(qs), -np.inf), np.array([np.sort(x @ q)[-min(n, 3)] for q in qs])):
            for q, floor, (rows, score) in zip(qs, floors, topk.read_block(topk.lists_of(x), qs, 6, floors)):
                every = x @ q
                least = max(floor, np.sort(every)[-min(n, 6)])
                assert score.tolist() == every[rows].tolist() and set(np.flatnonzero(every >= least)) <= set(rows.tolist())


def test_pipeline_stages(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = common.materialize(stage(spark, docs, d), "test-stage")
        if name != "packing":
            assert out.columns == docs.columns
            kept[name] = out
        docs = out
    toxic = toxicity.score_documents(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).where("predicted = 1")
    assert kept["toxicity"].join(toxic, "doc_id").count() == 0
    after = jaccard_join.jaccard_groups(kept["ngram_jaccard"])
    assert after.where("component_id <> doc_id").count() == 0
    assert docs.agg(F.sum("length")).first()[0] == docs.select("doc_id", "doc_tokens").distinct().join(kept["mixing"].groupBy("doc_id").count(), "doc_id").agg(F.sum(F.col("doc_tokens") * F.col("count"))).first()[0]


def edit_similarity(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        diagonal, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            diagonal, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, diagonal + (x != y))
    return 1 - row[-1] / max(len(a), len(b), 1)


def lines_left(texts):
    """Lines kept by linking all pairs of distinct lines by edit similarity, in order."""
    group = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if group[i] != group[j] and abs(len(texts[i]) - len(texts[j])) <= 90 and line_near(texts[i], texts[j]):
            old, new = max(group[i], group[j]), min(group[i], group[j])
            group = [new if g == old else g for g in group]
    return [t for i, t in enumerate(texts) if group[i] == i]


def test_lines_equal_all_pairs(spark):
    """Edited copies of lines of many lengths, some with a common passage, against all pairs by edit similarity."""
    rng = np.random.default_rng(3)
    passage = text_of(99, 30).split()
    texts = []
    for k in range(70):
        line = text_of(1000 + k, int(rng.integers(10, 130))).split()
        if k % 5 == 0:
            line[3:3] = passage
        texts.append(" ".join(line))
        for _ in range(3):
            edited = list(line)
            for _ in range(int(rng.integers(1, max(2, len(line) // 8 + 1)))):
                at, kind = int(rng.integers(0, len(edited))), rng.integers(0, 3)
                edited[at : at + (kind != 1)] = [] if kind == 0 else [WORDS[int(rng.integers(0, len(WORDS)))]]
            texts.append(" ".join(edited))
    order = rng.permutation(len(texts))
    texts = [texts[i] for i in order]
    out = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("n_removed = 0").orderBy("doc_id").collect()
    want = lines_left(texts)
    assert [r.text for r in out] == want and len(want) < len(texts) - 100


def test_lines_of_one_origin_meet_few_others(spark, monkeypatch):
    """300 copies of a line, each with more words changed, dropped or added than a link allows: all links are found, and the
    pairs that are compared stay far under all pairs."""
    rng = np.random.default_rng(12)
    base = [f"w{k}" for k in rng.integers(0, 4000, 60)]
    texts = []
    for k in range(300):
        line = list(base)
        for _ in range(7 + k % 6):
            at, kind = int(rng.integers(0, len(line))), rng.integers(0, 3)
            line[at : at + (kind != 1)] = [] if kind == 0 else [f"w{rng.integers(0, 4000)}"]
        texts.append(" ".join(line))
    held, materialize = [], line_dedup.materialize

    def counted(df, label):
        out = materialize(df, label)
        if label == "pairs":
            held.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "materialize", counted)
    out = line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("n_removed = 0").orderBy("doc_id").collect()
    assert [r.text for r in out] == lines_left(texts)
    assert sum(held) < 8 * len(texts), held


def test_lines_of_other_sizes_share_no_key(spark, monkeypatch):
    """Lines of 20 words, and ones of 60 in which those are the longest words: too far apart for a link at any edit, so they meet under no key;
    a copy with one word changed does."""
    rows = []
    for k in range(20):
        passage = [f"{chr(97 + k)}{chr(97 + i)}longestwords" for i in range(20)]
        rows += [" ".join(passage), " ".join([f"{chr(97 + k)}{i}" for i in range(40)] + passage)]
    crowds, materialize = [], line_dedup.materialize

    def counted(df, label):
        out = materialize(df, label)
        if label == "crowd":
            crowds.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "materialize", counted)
    removed = lambda texts: {r.doc_id for r in line_dedup.dedup_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("n_removed > 0").collect()}
    assert removed(rows) == set() and crowds == [0]
    assert removed([*rows, rows[0].replace("aclongestwords", "another")]) == {len(rows)} and crowds[1] > 0


def test_rows_of_a_key_meet_once_a_pair(spark):
    """Lines of one key in a large component and beside it: each pair of different components that shares enough keys is made
    by the join itself once, however many keys it shares; within the large component nothing is."""
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in range(60)]
    lines = []
    for k in range(40):
        line = list(words[: 56 + k % 5])
        for at in rng.integers(0, 50, 3):
            line[int(at)] = f"x{rng.integers(0, 9)}"
        lines.append((k, len(line), " ".join(line)))
    nodes = spark.createDataFrame(lines, "node long, n int, line string")
    distinct = line_dedup._marked(nodes).withColumn("place", F.col("node")).select("node", "n", "size", "even", "odd", "place")
    texts = line_dedup._texts(nodes.select("node"), distinct, nodes.withColumn("place", F.col("node")), wide=True)
    c = F.when(F.col("node") < 25, 0).otherwise(F.col("node")).cast("long")
    keys = {(k, n) for n, _, _ in lines for k in range(6) if (n + k) % 3 or n < 4}
    rows = spark.createDataFrame(sorted(keys), "key long, node long").withColumn("least", F.lit(2)).withColumn("c", c)
    rows = rows.join(distinct.drop("place"), "node").join(texts.select("node", *line_dedup.WIDE), "node")
    marks = distinct.drop("place").join(texts.select("node", *line_dedup.WIDE), "node")
    side = lambda p: marks.select(*[F.col(x).alias(f"{p}{x}") for x in marks.columns])
    may = {(r.a, r.b) for r in side("l_").join(side("r_"), F.col("l_node") > F.col("r_node")).where(line_dedup._possible("l_", "r_", line_dedup.WIDE)).select(F.col("l_node").alias("a"), F.col("r_node").alias("b")).collect()}
    shared = lambda a, b: len({k for k, n in keys if n == a} & {k for k, n in keys if n == b})
    want = sorted((a, b) for a, b in may if a >= 25 and shared(a, b) >= 2)
    assert 20 < len(want) < len(may)
    for listed in (True, False):
        assert sorted((r.a, r.b) for r in line_dedup._crossed(rows, line_dedup.WIDE, listed)[0].collect()) == want


def test_rows_in_buckets_stay_in_place(spark):
    """A join on the bucket's column moves the other side's rows only; the table goes with its files."""
    rows = common.materialize_by(spark.range(1000).select("id", (F.col("id") * 7).cast("decimal(38,0)").alias("place"), F.lit("text").alias("line")), "rows", "place")
    places = spark.range(10).select((F.col("id") * 70).cast("decimal(38,0)").alias("place"))
    found = rows.join(places.hint("shuffle_hash"), "place")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and found.count() == 10
    common.discard(rows)
    assert not spark.catalog.tableExists(rows.stored_as)


def test_lines_keep_numbers(spark):
    """Lines that differ in numbers only are not one line; equal ones are."""
    rows = [(1, "Sales in 2019 were 4,112 units"), (2, "Sales in 2020 were 977 units"), (3, "sales in 2019: were 4.112 units!")]
    out = {r.doc_id: r.n_removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: 0, 2: 0, 3: 1}


def test_top_products_of_large_components(spark):
    """Components over 2^22 and 1e15, and scores that doubles cannot tell apart."""
    x = [[1 / 64, 1.0, 0.5], [20000.0, 3.0, 1.0], [4e15, 1.0, 0.0], [4e15, 1.0, -0.25], [-30000.0, 2.0, 7.0], [2e5, -9.0, 3.0], [4e15, 1.25, 0.0]]
    got = topk.top_products(spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), k=6).orderBy("rank").collect()
    z = [[math.floor(256 * c) for c in v] for v in x]
    want = sorted(((-sum(a * b for a, b in zip(z[0], v)), i) for i, v in enumerate(z) if i), key=lambda p: p)
    assert [(r.vec_id, r.score) for r in got] == [(i, -s) for s, i in want]


def test_pipeline_keeps_token_ids(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.001"
    out = corpus_pipeline.packing_stage(spark, spark.read.parquet(f"{d}/documents.parquet").limit(20), d).collect()
    assert out and all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in out)


def test_long_flat_pages_count_tags():
    """Shares of equal tags among siblings, past 200 of them as under it."""
    for n in (50, 400):
        page = html_extract.Page("<body>" + "<p>a</p>" * n + "<div>b</div>" * n + "</body>")
        alike = page.features()[:, -2]
        assert [alike[e] for e in range(len(page.tag)) if page.tag[e] in ("p", "div")] == [0.5] * (2 * n)


def test_pipeline_stages_on_awkward_tables(spark):
    """Nulls, empty and very long texts, repeated rows, and columns that operators use for themselves."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    d = "/root/testdata/sf0.001"
    line = text_of(41, 40)
    texts = [(1, line), (2, line), (2, line), (3, None), (4, ""), (None, text_of(42, 20)), (5, "word " * 60_000), (6, text_of(43, 30)), (6, text_of(43, 30))]
    rows = [(i, t, None if i == 4 else "web", 7, f"s{k}", k, "e", 0.5) for k, (i, t) in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int, score string, n_lines long, `evidence` string, predicted double")
    docs = df
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), d).count() == 0
        out = common.materialize(stage(spark, docs, d), "test-stage")
        if name in ("toxicity", "line_dedup", "ngram_jaccard"):
            assert out.schema.simpleString() == df.schema.simpleString()
            assert {r.score: (r.n_lines, r.evidence, r.predicted) for r in out.collect()}.items() <= {f"s{k}": (k, "e", 0.5) for k in range(len(rows))}.items()
        docs = out
    assert {r.doc_id for r in docs.collect()} >= {1, 5}
