"""Spelling variants: words one edit apart, found by bands of letter-parity masks, and chains to their usual form.

A mask has a bit a letter, set where the letter comes an odd number of times. An inserted or deleted letter flips one
bit, a replaced one two. With the letters dealt over three bands, near words agree on two bands (one band holds all
flips; lengths equal or one apart), or on one band while each of the others differs by one bit (a replaced letter;
lengths equal, and the number of bits set changes its parity in both). Words meet in an equi-join on the equal bands and
the length, and an edit distance within the join confirms them. Each pair meets under one key only.

A key whose group is large is split by text: an edit leaves the front or the rear half of the longer word as it is, so
the group's words meet by equal halves. Groups of any size are handled whole. Everything is built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

RUN = r"[A-Za-zÀ-ÿ]+"
#: Letters by falling frequency, dealt to the bands in turn, so that each band has frequent and rare ones.
_LETTERS = "etaoinsrhldcumfpgwybvkxjqz" + "".join(map(chr, range(0xE0, 0x100))) + "".join(map(chr, range(0xC0, 0xE0)))
BANDS = tuple(_LETTERS[k::3] for k in range(3))
#: Words of one key that meet pair by pair; larger groups are split by equal halves first.
GROUP = 512


def observed_words(docs: DataFrame, least_length: int = 5, least_count: int = 3, damage: int | None = 97) -> DataFrame:
    """(word, n): distinct runs of Latin letters, A-Z lower-cased, of at least so many code points and occurrences.
    damage: runs whose crc32 of "doc_id:run" it divides lose the code point at crc32 modulo length; None: no run does."""
    runs = docs.select(F.col("doc_id").cast("string").alias("d"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("r"))
    runs = runs.select("d", F.translate("r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("r")).where(F.length("r") >= least_length)
    if damage is not None:
        runs = runs.withColumn("h", F.crc32(F.concat(F.coalesce("d", F.lit("")), F.lit(":"), F.col("r"))))
        at = F.pmod(F.col("h"), F.length("r")).cast("int")
        runs = runs.withColumn("r", F.when(F.pmod(F.col("h"), F.lit(damage)) == 0, F.concat(F.substring("r", F.lit(1), at), F.substring("r", at + 2, F.length("r")))).otherwise(F.col("r")))
        runs = runs.where(F.length("r") >= least_length)
    return runs.groupBy(F.col("r").alias("word")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def parity_mask(word: Column, letters: str) -> Column:
    """Bits of the letters that come an odd number of times."""
    place = lambda c: F.instr(F.lit(letters), c)
    known = F.filter(F.split(word, ""), lambda c: (c != "") & (place(c) > 0))
    return F.aggregate(known, F.lit(0), lambda mask, c: mask.bitwiseXOR(F.call_function("shiftleft", F.lit(1), place(c) - 1)))


def _odd(mask: Column) -> Column:
    return F.pmod(F.bit_count(mask), F.lit(2))


def _keys(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Left and right rows (kind, u, v, length, word, n, m0, m1, m2). kind 0 to 2: all bands but this one are equal; the
    right row is as long (kind unchanged) or shorter by one letter. 3 to 5: only band kind - 3 is equal."""
    m, size = [F.col("m0"), F.col("m1"), F.col("m2")], F.length("word")
    key = lambda kind, u, v, length: F.struct(F.lit(kind).cast("byte").alias("kind"), u.alias("u"), v.cast("int").alias("v"), length.alias("length"))
    two = [key(k, m[(k + 1) % 3], m[(k + 2) % 3], size) for k in range(3)]
    longer = [key(k, m[(k + 1) % 3], m[(k + 2) % 3], size + 1) for k in range(3)]
    one_left, one_right = [], []
    for k in range(3):
        a, b = _odd(m[(k + 1) % 3]), _odd(m[(k + 2) % 3])
        one_left.append(F.when(a == 0, key(3 + k, m[k], b, size)))
        one_right.append(F.when(a == 1, key(3 + k, m[k], 1 - b, size)))
    rows = lambda keys: words.select(F.explode(F.array_compact(F.array(*keys))).alias("key"), "word", "n", "m0", "m1", "m2").select("key.*", "word", "n", "m0", "m1", "m2")
    return rows(two + one_left), rows(two + longer + one_right)


_ON = ["kind", "u", "v", "length"]


def _split(rows: DataFrame, large: DataFrame) -> DataFrame:
    """rows with half: empty in small groups; rows of large ones once with each half of the group's longer length."""
    front = F.floor(F.col("length") / 2).cast("int")
    halves = F.array(F.concat(F.lit("<"), F.substring("word", F.lit(1), front)), F.concat(F.lit(">"), F.substring("word", -(F.col("length") - front), F.col("length"))))
    marked = rows.join(large, _ON, "left")
    return marked.withColumn("half", F.explode(F.when(F.col("many").isNull(), F.array(F.lit(""))).otherwise(halves))).drop("many")


def near_pairs(words: DataFrame, group: int | None = None) -> DataFrame:
    """(a, b, na, nb) of the distinct words that differ by exactly one inserted, deleted or replaced code point, each
    pair once. words: (word, n), each word once."""
    masks = words.select("word", "n", *[parity_mask(F.col("word"), b).alias(f"m{k}") for k, b in enumerate(BANDS)])
    left, right = _keys(masks)
    large = left.groupBy(*_ON).agg(F.count(F.lit(1)).alias("many")).where(F.col("many") > (GROUP if group is None else group))
    left, right = _split(left, large).alias("x"), _split(right, large).alias("y")
    flips = sum((F.bit_count(F.col(f"x.m{k}").bitwiseXOR(F.col(f"y.m{k}"))) for k in range(3)), F.lit(0))
    # words of one length meet from both sides: once is enough; words that agree in both halves meet by the front one
    once = (F.length("x.word") > F.length("y.word")) | (F.col("x.kind") >= 3) | (F.col("x.word") < F.col("y.word"))
    front = F.floor(F.col("x.length") / 2).cast("int")
    first = (F.substring("x.half", F.lit(1), F.lit(1)) != ">") | (F.substring("x.word", F.lit(1), front) != F.substring("y.word", F.lit(1), front))
    same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in [*_ON, "half"]]
    on = same[0]
    for c in [*same[1:], flips <= 2, once, first, F.levenshtein("x.word", "y.word", 1) == 1]:
        on = on & c
    return left.join(right, on).select(F.col("x.word").alias("a"), F.col("y.word").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"))


def variant_groups(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every observed word: its near word of largest n (ties: the smallest in
    code-point order) where that has at least twice its occurrences, and the word at the end of the forms.

    Null and empty texts give no words; a null doc_id counts as an empty one; repeated rows count again; very long runs
    are words like others; an empty table gives no rows. Other columns are not read.
    """
    words = materialize(observed_words(docs), "words")
    pairs = materialize(near_pairs(words), "near-words")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("nb").alias("m")).union(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("na").alias("m")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("near").alias("near"))).alias("best"))
    sized = words.join(best, "word", "left").withColumn("ok", -F.col("best.m") >= 2 * F.col("n"))
    formed = materialize(sized.select("word", F.when(F.col("ok"), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("ok"), -F.col("best.m")).alias("form_n")), "forms")
    discard(pairs, words)
    roots = _roots(formed.where("form is not null").select("word", F.col("form").alias("root")))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(steps: DataFrame) -> DataFrame:
    """(word, root): the ends of chains, each round twice as far. Occurrences double with every step, so chains are
    short and free of cycles. One row a round reaches the driver."""
    steps = materialize(steps.withColumn("moved", F.lit(True)), "roots")
    while steps.where("moved").take(1):
        ends = steps.select(F.col("word").alias("w"), F.col("root").alias("r"))
        old, steps = steps, materialize(steps.join(ends, F.col("root") == F.col("w"), "left").select("word", F.coalesce("r", "root").alias("root"), F.col("r").isNotNull().alias("moved")), "roots")
        discard(old)
    return steps.select("word", "root")
