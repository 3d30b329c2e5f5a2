"""Rows as multisets: duplicate keys matched row by row, and whole rows where there is no key.

Both sides are stacked and grouped by their canonical columns, which counts each distinct row on either side in one
shuffle with partial sums; a hot key or row is a count, not a group in memory. For duplicate keys the leftovers of
each key are counted in a second aggregate and joined back, so one key with most of all rows is still split."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.functions.canon import canonical, quoted
from rowlens.operators import classified
from rowlens.plans.options import Plan


def _stacked(left: DataFrame, right: DataFrame, plan: Plan, raws: bool = True) -> DataFrame:
    """Distinct canonical rows (c*, v*) with their numbers nl and nr and, with ``raws``, one raw row of each side."""
    parts = []
    for df, s in ((left, "l"), (right, "r")):
        kind = lambda f, s=s: (f.left if s == "l" else f.right).kind
        canon = lambda f, kind=kind: canonical(quoted(f.name), kind(f), f.domain, plan.options)
        raw = F.struct(*(quoted(f.name).alias(f"{s}k{i}") for i, f in enumerate(plan.keys)), *(quoted(f.name).alias(f"{s}{i}") for i, f in enumerate(plan.values)))
        other = "struct<" + ",".join([f"{'r' if s == 'l' else 'l'}k{i}:{_type(right if s == 'l' else left, f.name)}" for i, f in enumerate(plan.keys)] + [f"{'r' if s == 'l' else 'l'}{i}:{_type(right if s == 'l' else left, f.name)}" for i, f in enumerate(plan.values)]) + ">"
        none = F.lit(None).cast(other)
        parts.append(df.select(
            *(canon(f).alias(f"c{i}") for i, f in enumerate(plan.keys)), *(canon(f).alias(f"v{i}") for i, f in enumerate(plan.values)),
            F.lit(int(s == "l")).cast("long").alias("nl"), F.lit(int(s == "r")).cast("long").alias("nr"),
            *([(raw if s == "l" else none).alias("left"), (raw if s == "r" else none).alias("right")] if raws else []),
        ))
    by = [f"c{i}" for i in range(len(plan.keys))] + [f"v{i}" for i in range(len(plan.values))]
    rows = [F.max("left").alias("left"), F.max("right").alias("right")] if raws else []
    return parts[0].union(parts[1]).groupBy(*by).agg(F.sum("nl").alias("nl"), F.sum("nr").alias("nr"), *rows)


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _counted(left: DataFrame, right: DataFrame, plan: Plan) -> DataFrame:
    """As :func:`_stacked`, with each key's leftovers ll and lr (without keys: of the row itself)."""
    g = _stacked(left, right, plan)
    g = g.withColumns({"xl": F.greatest(F.col("nl") - F.col("nr"), F.lit(0)), "xr": F.greatest(F.col("nr") - F.col("nl"), F.lit(0))})
    if not plan.keys:
        return g.withColumns({"ll": F.col("xl"), "lr": F.col("xr"), "paired": F.lit(False)})
    n = len(plan.keys)
    per = g.groupBy(*(F.col(f"c{i}").alias(f"q{i}") for i in range(n))).agg(F.sum("xl").alias("ll"), F.sum("xr").alias("lr"))
    on = reduce(lambda a, b: a & b, (F.col(f"c{i}").eqNullSafe(F.col(f"q{i}")) for i in range(n)))
    return g.join(per, on).withColumn("paired", (F.col("ll") == 1) & (F.col("lr") == 1))


def classify(left: DataFrame, right: DataFrame, plan: Plan) -> DataFrame:
    """All rows: what cancels is unchanged; a key left with one row on each side changed; the rest is removed or added."""
    g = _counted(left, right, plan)
    nk, nv = range(len(plan.keys)), range(len(plan.values))

    def rows(df: DataFrame, inl: Column, inr: Column) -> DataFrame:
        cols = [F.col(f"left.lk{i}").alias(f"lk{i}") for i in nk] + [F.col(f"right.rk{i}").alias(f"rk{i}") for i in nk]
        cols += [F.when(inl, F.col(f"left.l{i}")).alias(f"l{i}") for i in nv] + [F.when(inr, F.col(f"right.r{i}")).alias(f"r{i}") for i in nv]
        return df.select(*cols, inl.alias("inl"), inr.alias("inr"))

    # a distinct row gives what cancels, as often as it does, and what is left on one side, unless that is one half of a pair
    none, left_over = F.lit(0).cast("long"), F.when(F.col("paired"), F.lit(0).cast("long")).otherwise(F.col("xl") + F.col("xr"))
    part = lambda n, inl, inr: F.struct(n.cast("long").alias("n"), inl.alias("inl"), inr.alias("inr"))
    out = g.withColumn("__p", F.explode(F.array(part(F.least("nl", "nr"), F.lit(True), F.lit(True)), part(left_over, F.col("xl") > 0, F.col("xr") > 0)))).where(F.col("__p.n") > none)
    out = rows(out.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__p.n")))), F.col("__p.inl"), F.col("__p.inr"))
    if plan.keys:
        pair = g.where(F.col("paired") & ((F.col("xl") > 0) | (F.col("xr") > 0)))
        one = pair.groupBy(*(f"c{i}" for i in nk)).agg(F.max(F.when(F.col("xl") > 0, F.col("left"))).alias("left"), F.max(F.when(F.col("xr") > 0, F.col("right"))).alias("right"))
        out = out.unionByName(rows(one, F.lit(True), F.lit(True)))
    return classified.judge(out.select(*classified.key_columns(plan), *(f"l{i}" for i in nv), *(f"r{i}" for i in nv), "inl", "inr"), plan)


def counts(left: DataFrame, right: DataFrame, plan: Plan) -> DataFrame:
    """The counts without expanding rows (tolerance apart): left_rows, right_rows, added, removed, changed, unchanged, dup_keys, dup_rows."""
    g = _stacked(left, right, plan, raws=False)
    same, xl, xr = F.least("nl", "nr"), F.greatest(F.col("nl") - F.col("nr"), F.lit(0)), F.greatest(F.col("nr") - F.col("nl"), F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    if not plan.keys:
        return g.agg(zero(F.sum("nl")).alias("left_rows"), zero(F.sum("nr")).alias("right_rows"), zero(F.sum(xr)).alias("added"), zero(F.sum(xl)).alias("removed"), F.lit(0).cast("long").alias("changed"), zero(F.sum(same)).alias("unchanged"))
    per = g.groupBy(*(f"c{i}" for i in range(len(plan.keys)))).agg(F.sum("nl").alias("nl"), F.sum("nr").alias("nr"), F.sum(same).alias("same"), F.sum(xl).alias("ll"), F.sum(xr).alias("lr"))
    paired = (F.col("ll") == 1) & (F.col("lr") == 1)
    return per.agg(
        zero(F.sum("nl")).alias("left_rows"), zero(F.sum("nr")).alias("right_rows"), zero(F.sum(F.when(~paired, F.col("lr")))).alias("added"), zero(F.sum(F.when(~paired, F.col("ll")))).alias("removed"),
        F.count_if(paired).alias("changed"), zero(F.sum("same")).alias("unchanged"), F.count_if(F.col("nl") > 1).alias("dup_keys"), zero(F.sum(F.when(F.col("nl") > 1, F.col("nl")))).alias("dup_rows"),
    )
