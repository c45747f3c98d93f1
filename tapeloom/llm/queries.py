"""The queries of this subpackage, one for each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, html_extract, jaccard_join, line_dedup, minhash, mixing, packing, periodic_runs, sharding, spelling, token_files, topk, toxicity
from .common import new_path

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file, the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score_documents(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "evidence", "cosine")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digest(packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 24)


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op9_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_products(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return token_files.read_token_files(spark, path, digest=True)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(table(spark, sf_dir, "documents"))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digest(periodic_runs.find_runs(periodic_runs.with_repeats(table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_toxicity": op3_toxicity,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_packing": op5_packing,
    "op6_mixing": op6_mixing,
    "op7_sharding": op7_sharding,
    "op8_nearest": op8_nearest,
    "op9_top_products": op9_top_products,
    "op10_token_files": op10_token_files,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_minhash_dedup": op12_minhash_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}

_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    pow((('0x' || substring(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0,
      1.0 / CASE WHEN coalesce(length(text), 0) = 0 THEN 1.0
        ELSE greatest(0.1, length(translate(text, '0123456789#$%&*<>{}[]|\^~=+_@/', ''))::DOUBLE / length(text)) END) AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s),
f AS (SELECT *, cap / w AS fill FROM w),
g AS (SELECT *,
    sum(source_size) OVER ()::BIGINT * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_rest
  FROM f),
t AS (SELECT source, source_size, CASE WHEN fill * w_rest <= rest THEN cap ELSE
    w * first_value(CASE WHEN fill * w_rest <= rest THEN NULL ELSE rest / w_rest END IGNORE NULLS)
      OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) END AS target FROM g),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS copies,
    (sum(d.size) OVER (PARTITION BY d.source ORDER BY k DESC, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size)::BIGINT AS run
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (copies * size + greatest(0, least(size, round(target - copies * source_size)::BIGINT - run)))::BIGINT AS taken
FROM r
"""

_JACCARD_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 OR ws IS NULL THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, len(g)::BIGINT AS n_shingles FROM s),
x AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * common >= 75 * (na.n_shingles + nb.n_shingles - common)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n_shingles, least(n.doc_id, coalesce(min(r.b), n.doc_id)) AS component_id FROM n LEFT JOIN r ON n.doc_id = r.a GROUP BY n.doc_id, n_shingles
"""

_MINHASH_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 OR ws IS NULL THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i+2], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, len(g)::BIGINT AS n_shingles FROM s),
x AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * common >= 85 * (na.n_shingles + nb.n_shingles - common)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT n.doc_id, n_shingles, least(n.doc_id, coalesce(min(r.b), n.doc_id)) AS component_id FROM n LEFT JOIN r ON n.doc_id = r.a GROUP BY n.doc_id, n_shingles)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM c
"""

_PRODUCT_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

# crc32 is linear: that of n zero bytes, xor the share of each byte with as many zero bytes behind it. Letters beyond
# ASCII are mapped to single bytes, as this levenshtein counts bytes.
_SPELLING_SQL = r"""
WITH RECURSIVE bits(b, v, k) AS (SELECT i, i::BIGINT, 0 FROM range(256) t(i) UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
t AS (SELECT b, v FROM bits WHERE k = 8),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
o AS (SELECT doc_id, run, count(*) AS times, coalesce(doc_id::VARCHAR, '') || ':' || run AS msg FROM r WHERE length(run) >= 5 GROUP BY doc_id, run),
longest AS (SELECT max(strlen(msg)) AS n FROM o),
share(k, b, v) AS (SELECT 0, b, v FROM t UNION ALL SELECT k + 1, s.b, xor(s.v >> 8, t.v) FROM share s JOIN t ON t.b = s.v & 255 WHERE k < (SELECT n FROM longest)),
zero(n, v) AS (SELECT 0, 4294967295::BIGINT UNION ALL SELECT n + 1, xor(z.v >> 8, t.v) FROM zero z JOIN t ON t.b = z.v & 255 WHERE n < (SELECT n FROM longest)),
bytes AS (SELECT msg, hex(encode(msg)) AS h, strlen(msg) AS n, unnest(range(strlen(msg))) AS k FROM (SELECT DISTINCT msg FROM o)),
sums AS (SELECT msg, n, bit_xor(s.v) AS v FROM bytes JOIN share s ON s.k = n - 1 - bytes.k AND s.b = ('0x' || substr(h, 2 * bytes.k + 1, 2))::INT GROUP BY msg, n),
crc AS (SELECT msg, xor(xor(z.v, 4294967295), sums.v) AS h FROM sums JOIN zero z USING (n)),
w AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM o JOIN crc USING (msg)),
v AS (SELECT word, sum(times)::BIGINT AS n FROM w WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
e AS (SELECT word, n, length(word) AS size, translate(word, 'ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&()*+,-./:;<=>?@[]^_{|}~') AS x FROM v),
p AS (SELECT a.word, b.word AS near, b.n AS m FROM e a JOIN e b ON b.size BETWEEN a.size - 1 AND a.size + 1 AND a.word <> b.word WHERE levenshtein(a.x, b.x) = 1),
f AS (SELECT word, count(*) AS n_near, arg_min(near, (-m, near)) AS best, max(m) AS m FROM p GROUP BY word),
g AS (SELECT v.word, CASE WHEN m >= 2 * n THEN best END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * n THEN m END::BIGINT AS form_n FROM v LEFT JOIN f USING (word)),
c(word, till) AS (SELECT word, word FROM g UNION ALL SELECT c.word, g.form FROM c JOIN g ON c.till = g.word WHERE g.form IS NOT NULL),
d AS (SELECT c.word, c.till AS root FROM c JOIN g ON c.till = g.word WHERE g.form IS NULL)
SELECT g.word, form, root, n, n_near, form_n FROM g JOIN d USING (word)
"""

SQL: dict[str, str] = {"op4_ngram_jaccard": _JACCARD_SQL, "op6_mixing": _MIX_SQL, "op9_top_products": _PRODUCT_SQL, "op11_spelling_variants": _SPELLING_SQL, "op12_minhash_dedup": _MINHASH_SQL}
