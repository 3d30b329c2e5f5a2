"""Mixing sources to target weights along a time-varying curriculum, with DataFrame operations only.

Each source has a weight schedule over training time t in [0, 1]: its share of the mix times
``1 + tilt * (2 t - 1)``, whose integral over the run is the source's target. A source's documents stand in a
seeded order (by a hash of id and text); the words before a document are cumulative demand, and inverting the integrated schedule
``D(t) = target * ((1 - tilt) t + tilt t^2)`` at that demand gives the document's training position. A source
whose target exceeds its size is passed through a second time. The last document of a source is cut at the
target, so a source's taken words equal its rounded target.

Prefix sums are two-level: sums over (source, hash bucket), then within each bucket, so a source that holds
most of all rows is spread over ``16**3`` groups. The order is that of the full hash, so results do not depend
on the layout. No text is shuffled.

Defined results: a null text has size 0; null sources form one source that comes last; rows that share a
doc_id are separate documents; an empty table gives an empty result; a document of size 0, or one behind its
source's target, has taken 0 and a null position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowlens.llm.common import WORD, free, materialize, row_keyed

#: The row key that the training order gives its input.
ROW = "__row"
WEIGHTS, BUDGET, CAP, TILTS = (3, 1, 2), 1.5, 2.0, (0.0, 0.5, -0.5)


def _at(values: tuple, rank: Column) -> Column:
    out = F.lit(float(values[-1]))
    for i, v in enumerate(values[:-1]):
        out = F.when(F.pmod(rank - 1, F.lit(len(values))) == i, F.lit(float(v))).otherwise(out)
    return out


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget=BUDGET, cap=CAP, tilts=TILTS) -> DataFrame:
    """One row per source of ``sizes`` (skey, size): source_size, target and tilt, by water filling.

    Sources in the order of cap per weight are capped until the level reached by the rest lies below their own.
    The windows run over the table of sources, which has been aggregated."""
    totals = sizes.groupBy("skey").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy("skey")))
    ranked = ranked.withColumn("w", _at(weights, F.col("rank"))).withColumn("tilt", _at(tilts, F.col("rank")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(cap))
    order = Window.orderBy(F.col("cap") / F.col("w"), "skey")
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(budget) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)
    ranked = ranked.withColumn("level", level)
    ranked = ranked.withColumn("open", F.col("w") * F.col("level") <= F.col("cap")).withColumn("n", F.row_number().over(order))
    ranked = ranked.withColumn("first", F.min(F.when(F.col("open"), F.col("n"))).over(everything)).withColumn("final", F.max(F.when(F.col("n") == F.col("first"), F.col("level"))).over(everything))
    return ranked.select("skey", "source_size", "tilt", F.when(F.col("n") < F.col("first"), F.col("cap")).otherwise(F.col("w") * F.col("final")).alias("target"))


def assign(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=WEIGHTS, budget=BUDGET, cap=CAP, tilts=TILTS, row_col: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_taken, second_taken, position, second_position per row of ``docs``,
    and ``row_col``, if given: a unique key of the rows."""
    row = [] if row_col is None else [row_col]
    if cap > 2:
        raise ValueError("a document is passed at most twice")
    h = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(text_col), F.lit(""))))
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.concat(F.lit("0"), source_col), F.lit("1")).alias("skey"), h.alias("h"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *row,
    )
    sized = materialize(sized, "mix-sizes").withColumn("bucket", F.substring("h", 1, 3))
    blocks = sized.groupBy("skey", "bucket").agg(F.sum("size").alias("in_block"))
    ahead = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("skey", "bucket", F.coalesce(F.sum("in_block").over(ahead), F.lit(0)).alias("ahead"))
    blocks = blocks.join(source_targets(sized, weights, budget, cap, tilts), "skey")
    within = Window.partitionBy("skey", "bucket").orderBy("h", "doc_id", "size", *row).rowsBetween(Window.unboundedPreceding, -1)
    at = sized.join(blocks, ["skey", "bucket"]).withColumn("start", F.col("ahead") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    wanted = F.floor(F.col("target") + 0.5)

    def taken(start: Column) -> Column:
        return F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), wanted - start)).cast("long")

    def position(start: Column, words: Column) -> Column:
        u, a = start / wanted, F.col("tilt")
        return F.when((words > 0) & (wanted > 0), F.lit(2.0) * u / ((F.lit(1.0) - a) + F.sqrt((F.lit(1.0) - a) * (F.lit(1.0) - a) + F.lit(4.0) * a * u)))

    again = F.col("start") + F.col("source_size")
    at = at.withColumn("first_taken", taken(F.col("start"))).withColumn("second_taken", taken(again))
    return at.select(
        "doc_id", "size", "source_size", "target", (F.col("first_taken") + F.col("second_taken")).alias("taken"), "first_taken", "second_taken",
        position(F.col("start"), F.col("first_taken")).alias("position"), position(again, F.col("second_taken")).alias("second_position"), *row,
    )


def training_order(docs: DataFrame, id_col="doc_id", **options) -> DataFrame:
    """The columns of ``docs`` and ``mix_pass`` (0, 1), ``mix_words`` (of the text that this pass takes) and
    ``mix_position``, one row per pass of a document, range-sorted by position. Documents not taken do not come.

    Passes are joined to documents by a key of the row (see :func:`rowlens.llm.common.row_keyed`), so ids may be null or shared. Columns of
    ``docs`` by the three names are replaced."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("mix_pass", "mix_words", "mix_position")))
    row = free(docs, ROW)
    keyed = row_keyed(docs, row, "mix-rows")
    passes = F.array(*(F.struct(F.lit(i).alias("p"), F.col(w).alias("w"), F.col(t).alias("t")) for i, (w, t) in enumerate((("first_taken", "position"), ("second_taken", "second_position")))))
    a = assign(keyed, id_col, row_col=row, **options).select(F.col(row), F.explode(passes).alias("mix")).select(row, F.col("mix.p").alias("mix_pass"), F.col("mix.w").alias("mix_words"), F.col("mix.t").alias("mix_position"))
    return keyed.join(a.where("mix_words > 0"), row).drop(row).orderBy("mix_position", id_col, "mix_pass")
