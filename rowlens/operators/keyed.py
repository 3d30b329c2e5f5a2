"""Rows matched by key: one full outer join on canonical keys, null-safe, so null keys meet null keys.

Every row is classified in the joined row itself: no second scan, no attribution pass. The join is a sort-merge or
shuffled-hash join that spills; its keys are unique on each side, so no task gets more than its share of keys. Only key
and compared columns are shuffled."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowlens.errors import DiffError
from rowlens.functions.canon import canonical, hash_of, key_text, quoted, shown
from rowlens.operators import classified
from rowlens.plans.options import Plan


def _joined(left: DataFrame, right: DataFrame, plan: Plan) -> DataFrame:
    n = len(plan.keys)
    right = right.withColumnsRenamed({f"c{i}": f"q{i}" for i in range(n)})
    on = reduce(lambda a, b: a & b, (F.col(f"c{i}").eqNullSafe(F.col(f"q{i}")) for i in range(n)))
    return left.withColumn("inl", F.lit(True)).join(right.withColumn("inr", F.lit(True)), on, "full_outer").withColumns({"inl": F.coalesce("inl", F.lit(False)), "inr": F.coalesce("inr", F.lit(False))})


def classify(left: DataFrame, right: DataFrame, plan: Plan, details: bool = True) -> DataFrame:
    """Keys are taken to be unique on each side (see :func:`duplicates`)."""
    j = _joined(classified.side(left, plan, "l"), classified.side(right, plan, "r"), plan)
    cols = [f"{s}{i}" for s in "lr" for i in range(len(plan.values))]
    return classified.judge(j.select(*classified.key_columns(plan), *cols, "inl", "inr"), plan, details)


def summarize(left: DataFrame, right: DataFrame, plan: Plan) -> DataFrame:
    """Counts only: values shrink to a 64-bit hash before the shuffle, so wide rows cost 16 bytes and their key."""
    def narrow(df: DataFrame, s: str) -> DataFrame:
        kind = lambda f: (f.left if s == "l" else f.right).kind
        c = lambda f: canonical(quoted(f.name), kind(f), f.domain, plan.options)
        return df.select(*(c(f).alias(f"c{i}") for i, f in enumerate(plan.keys)), hash_of([c(f) for f in plan.values]).alias(f"{s}h"))

    j = _joined(narrow(left, "l"), narrow(right, "r"), plan)
    status = F.when(~F.col("inl"), classified.ADDED).when(~F.col("inr"), classified.REMOVED).when(F.col("lh") == F.col("rh"), classified.UNCHANGED).otherwise(classified.CHANGED)
    return classified.counts(j.select(status.alias("status")))


def duplicates(df: DataFrame, plan: Plan, which: str = "l") -> DataFrame:
    """Keys that stand more than once on a side: key (as shown), n."""
    c = classified.side(df, plan, which)
    by = [f"c{i}" for i in range(len(plan.keys))]
    key = key_text([shown(F.col(f"k{i}"), (f.left if which == "l" else f.right).kind) for i, f in enumerate(plan.keys)])
    found = c.groupBy(*by).agg(F.count("*").alias("n"), *(F.min(f"{which}k{i}").alias(f"k{i}") for i in range(len(plan.keys)))).where("n > 1")
    return found.select(key.alias("key"), "n")


def refuse_duplicates(left: DataFrame, right: DataFrame, plan: Plan) -> tuple[int, int]:
    """One job over the keys of both sides; the rows of each, if no key stands twice on a side. It runs before the join,
    which a key that many rows share on both sides would blow up."""
    by = [f"c{i}" for i in range(len(plan.keys))]
    keys = lambda df, s: classified.side(df, plan, s).select(F.lit(s == "l").alias("side"), *by)
    both = keys(left, "l").union(keys(right, "r")).groupBy("side", *by).agg(F.count("*").alias("n"))
    found = {r["side"]: r for r in both.groupBy("side").agg(F.sum("n").alias("rows"), F.max("n").alias("most")).collect()}
    for side, df, s, name in ((True, left, "l", "left"), (False, right, "r", "right")):
        if side in found and found[side]["most"] > 1:
            hit = duplicates(df, plan, s).first()
            raise DiffError(f"key {hit['key']} stands {hit['n']} times on the {name} side; see on-dup warn and match")
    return tuple(found[s]["rows"] if s in found else 0 for s in (True, False))


def classify_first(left: DataFrame, right: DataFrame, plan: Plan) -> DataFrame:
    """on-dup warn: the first row of each key counts, by ``options.order_by`` or else by the order of reading.

    A further row is marked ``dup_left`` or ``dup_right``, with a null status; rows of keys that the left side does not
    have are all added."""
    by = [f"c{i}" for i in range(len(plan.keys))]

    def numbered(df: DataFrame, s: str) -> DataFrame:
        order = [quoted(c) for c in plan.options.order_by if c in df.columns]
        df = df.select("*", *(o.alias(f"__o{i}") for i, o in enumerate(order or [F.monotonically_increasing_id()])))
        extra = [c for c in df.columns if c.startswith("__o")]
        kind = lambda f: (f.left if s == "l" else f.right).kind
        cols = [canonical(quoted(f.name), kind(f), f.domain, plan.options).alias(f"c{i}") for i, f in enumerate(plan.keys)]
        cols += [quoted(f.name).alias(f"{s}k{i}") for i, f in enumerate(plan.keys)] + [quoted(f.name).alias(f"{s}{i}") for i, f in enumerate(plan.values)]
        return df.select(*cols, F.row_number().over(Window.partitionBy(*(canonical(quoted(f.name), kind(f), f.domain, plan.options) for f in plan.keys)).orderBy(*extra)).alias(f"{s}n"))

    a, b = numbered(left, "l"), numbered(right, "r")
    vals = [f"{s}{i}" for s in "lr" for i in range(len(plan.values))]
    j = _joined(a.where("ln = 1"), b, plan).withColumn("dup_right", F.col("inl") & F.coalesce(F.col("rn") > 1, F.lit(False)))
    rows = classified.judge(j.select(*classified.key_columns(plan), *vals, "inl", "inr", "dup_right"), plan)
    rows = rows.withColumn("dup_left", F.lit(False)).withColumn("status", F.when(~F.col("dup_right"), F.col("status")))
    flags = {f"d{i}": F.col(f"d{i}") & ~F.col("dup_right") for i in range(len(plan.values))} | {f"a{i}": F.when(~F.col("dup_right"), F.col(f"a{i}")) for i in range(len(plan.values))}
    rows = rows.withColumns(flags) if flags else rows
    more = a.where("ln > 1").withColumns({"inl": F.lit(True), "inr": F.lit(False)} | {f"rk{i}": F.col(f"lk{i}") for i in range(len(plan.keys))})
    more = more.select(*classified.key_columns(plan), *(f"l{i}" for i in range(len(plan.values)))).withColumn("dup_left", F.lit(True)).withColumn("dup_right", F.lit(False))
    return rows.unionByName(more, allowMissingColumns=True)


def dup_columns() -> list:
    return [F.count_if("dup_left").alias("dups_left"), F.count_if("dup_right").alias("dups_right")]


def count_first(rows: DataFrame) -> DataFrame:
    return rows.agg(*classified.count_columns(), *dup_columns())
