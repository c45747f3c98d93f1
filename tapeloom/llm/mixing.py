"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, unit_interval, word_count

#: Keys of a source fall into so many cells; only within a cell are rows sorted.
CELLS = 4096
WEIGHTS = (5, 2, 1)


def quality_weight(text: Column) -> Column:
    """Share of characters other than digits and symbols, from 0.1 to 1; 1 for null or empty text."""
    n = F.length(text)
    clean = F.length(F.translate(text, "0123456789#$%&*<>{}[]|\\^~=+_@/", ""))
    return F.when(F.coalesce(n, F.lit(0)) == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.1), clean / n))


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target): the budget is dealt by weight, no source above `most` times its size,
    the excess reshared by weight. Closed form: sources fill up in order of limit / weight, and the rest
    share what is left. One row for each source, so the two windows hold sources, not documents."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", cycle).withColumn("limit", F.col("source_size") * F.lit(most)).withColumn("fill", F.col("limit") / F.col("w"))
    all_rows = Window.partitionBy()
    before = Window.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("left", F.sum("source_size").over(all_rows) * F.lit(budget) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    s = s.withColumn("w_left", F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    full = F.col("fill") * F.col("w_left") <= F.col("left")
    # the first source that does not fill up sets the level for all from there on
    every = Window.orderBy("fill", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", F.first(F.when(~full, F.col("left") / F.col("w_left")), ignorenulls=True).over(every))
    return s.select("source", "source_size", F.when(full, F.col("limit")).otherwise(F.col("w") * F.col("level")).alias("target"))


def mix_sources(docs: DataFrame, weights=WEIGHTS, budget: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, part_words, taken) for each document.

    A source with target T and size S takes each document floor(T / S) times, then documents by falling key
    u^(1 / quality weight) until the words of T are reached; the one at the border is cut (part_words).
    u comes from md5 of the doc_id, so reruns agree. Sums go source -> cell of keys -> row: cells are summed
    with map-side combine, and rows are sorted only within a cell, so a hot source is spread over 4,096 cells.

    Null text has size 0 and is taken 0 words; null source is a source of its own, last in order; repeated
    rows and equal keys follow each other by doc_id and size; an empty table gives no rows.
    """
    u = unit_interval(F.col("doc_id"), seed)
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.pow(u, F.lit(1.0) / quality_weight(F.col("text"))).alias("key"))
    slim = materialize(slim.withColumn("cell", F.least(F.lit(CELLS - 1), F.floor((1 - F.col("key")) * CELLS)).cast("int")), "mix")
    cells = materialize(slim.groupBy("source", "cell").agg(F.sum("size").alias("cell_size")), "cells")
    targets = source_targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, budget, most)
    before = F.sum("cell_size").over(Window.partitionBy("source").orderBy("cell")) - F.col("cell_size")
    info = cells.withColumn("before", before).alias("c").join(targets.alias("t"), F.col("c.source").eqNullSafe(F.col("t.source")))
    info = info.select(F.col("c.source").alias("s"), F.col("cell").alias("k"), "before", "source_size", "target")
    rows = slim.join(info, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("k")))
    run = F.sum("size").over(Window.partitionBy("source", "cell").orderBy(F.col("key").desc(), "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    copies = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.round(F.col("target") - F.col("copies") * F.col("source_size")).cast("long")
    room = F.col("rest") - (F.col("before") + F.col("run") - F.col("size"))
    return (
        rows.withColumn("run", run).withColumn("copies", copies).withColumn("rest", rest)
        .withColumn("part_words", F.greatest(F.lit(0), F.least(F.col("size"), room)).cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", "part_words", (F.col("copies") * F.col("size") + F.col("part_words")).alias("taken"))
    )


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents themselves, each repeated as often as the mix takes it. Documents stay whole: the one that
    a source's border cuts is taken if the mix takes at least half of it. Columns and order of columns are
    those of docs. Rows of one doc_id share a count, that of the first of them."""
    mix = mix_sources(docs, **how).groupBy("doc_id").agg(F.max(F.col("copies") + ((F.col("part_words") > 0) & (2 * F.col("part_words") >= F.col("size"))).cast("long")).alias("__times"))
    joined = docs.join(mix.where("__times > 0").withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id")))
    return joined.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)
