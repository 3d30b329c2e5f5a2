"""The table that every engine yields, and what is computed from it.

Columns: k0.. (keys as shown to the user: left, or right where added), l0.. and r0.. (raw values), status, d0.. (value i
differs beyond tolerance, in changed rows), a0.. (absolute difference of numeric values). Positional names can't
collide with the user's; they become names at the edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowlens.functions.canon import canonical, key_text, quoted, shown, typed
from rowlens.functions.mask import masked
from rowlens.plans.options import Field, Plan
from rowlens.plans.types import Domain, Kind

ADDED, REMOVED, CHANGED, UNCHANGED, WITHIN = "added", "removed", "changed", "unchanged", "within_tolerance"


def differences(plan: Plan) -> list[tuple[Column, Column, Column]]:
    """For each value of a pair (l_i, r_i): whether it differs, whether beyond tolerance, and the absolute difference."""
    out = []
    for i, v in enumerate(plan.values):
        left, right = F.col(f"l{i}"), F.col(f"r{i}")
        differs = ~canonical(left, v.left.kind, v.domain, plan.options).eqNullSafe(canonical(right, v.right.kind, v.domain, plan.options))
        dist, beyond = F.lit(None).cast("double"), differs
        if v.numeric:
            a, b = left.cast("double"), right.cast("double")
            dist = F.when(left.isNotNull() & right.isNotNull() & ~F.isnan(a) & ~F.isnan(b), F.abs(a - b))
            if v.bound:
                inside = F.lit(False)
                if v.bound.absolute:
                    inside = inside | (dist <= F.lit(v.bound.absolute))
                if v.bound.relative:
                    inside = inside | (dist <= F.lit(v.bound.relative) * F.greatest(F.abs(a), F.abs(b)))
                beyond = differs & ~F.coalesce(inside, F.lit(False))
        out.append((differs, beyond, dist))
    return out


def judge(pairs: DataFrame, plan: Plan, details: bool = True) -> DataFrame:
    """Classify rows with columns k*, l*, r*, inl, inr (presence)."""
    diffs = differences(plan)
    any_of = lambda cols: F.array_contains(F.array(*cols), True) if len(cols) > 40 else _or(cols)
    status = F.when(~F.col("inl"), ADDED).when(~F.col("inr"), REMOVED)
    if diffs:
        if plan.tolerant:
            status = status.when(any_of([b for _, b, _ in diffs]), CHANGED).when(any_of([d for d, _, _ in diffs]), WITHIN)
        else:
            status = status.when(any_of([d for d, _, _ in diffs]), CHANGED)
    pairs = pairs.withColumn("status", status.otherwise(UNCHANGED)).drop("inl", "inr")
    return detailed(pairs, plan) if details else pairs


def detailed(rows: DataFrame, plan: Plan) -> DataFrame:
    """Rows with a status, and of each value whether and how far it differs. Best computed on differing rows read back: beside
    the join, the many expressions make one method that the JVM does not compile."""
    changed, diffs = F.col("status") == CHANGED, differences(plan)
    extra = {f"d{i}": changed & b for i, (_, b, _) in enumerate(diffs)} | {f"a{i}": F.when(changed & b, dist) for i, (_, b, dist) in enumerate(diffs)}
    return rows.withColumns(extra) if extra else rows


def _or(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out | c
    return out


def side(df: DataFrame, plan: Plan, prefix: str) -> DataFrame:
    """One input as canonical keys c0.., raw keys <p>k0.. and raw values <p>0..; unused columns never leave the scan."""
    kind = lambda f: (f.left if prefix == "l" else f.right).kind
    cols = [canonical(quoted(f.name), kind(f), f.domain, plan.options).alias(f"c{i}") for i, f in enumerate(plan.keys)]
    cols += [quoted(f.name).alias(f"{prefix}k{i}") for i, f in enumerate(plan.keys)]
    cols += [quoted(f.name).alias(f"{prefix}{i}") for i, f in enumerate(plan.values)]
    return df.select(*cols)


def key_columns(plan: Plan) -> list[Column]:
    """Keys as shown: the left's, the right's for added rows, in the wider type where the sides differ."""
    return [F.when(F.col("inl"), typed(F.col(f"lk{i}"), f.domain)).otherwise(typed(F.col(f"rk{i}"), f.domain)).alias(f"k{i}") for i, f in enumerate(plan.keys)]


def count_columns() -> list[Column]:
    """Aggregates over classified rows: the counts."""
    n = lambda s: F.count_if(F.col("status") == s)
    both = n(CHANGED) + n(UNCHANGED) + n(WITHIN)
    return [(n(REMOVED) + both).alias("left_rows"), (n(ADDED) + both).alias("right_rows"), n(ADDED).alias("added"), n(REMOVED).alias("removed"), n(CHANGED).alias("changed"), n(UNCHANGED).alias("unchanged"), n(WITHIN).alias("within_tolerance")]


def stat_columns(plan: Plan) -> list[Column]:
    """Aggregates over classified rows: for each value column the changes, and the largest and mean difference."""
    out = [F.count_if(F.col("status").isin(CHANGED, UNCHANGED, WITHIN)).alias("compared")]
    for i in range(len(plan.values)):
        out += [F.count_if(F.col(f"d{i}")).alias(f"n{i}"), F.max(f"a{i}").alias(f"max{i}"), F.avg(f"a{i}").alias(f"mean{i}")]
    return out


def stats_of(row: dict, plan: Plan, n: int) -> dict[str, dict]:
    """Statistics of the changed columns from a row of :func:`stat_columns`, most changes first; n: rows on both sides."""
    some = [(v.name, {"numeric": v.numeric, "changed": c, "match_rate": 1 - c / n if n else 1.0, "max_abs_diff": row[f"max{i}"], "mean_abs_diff": row[f"mean{i}"]}) for i, v in enumerate(plan.values) if (c := row[f"n{i}"])]
    return dict(sorted(some, key=lambda x: (-x[1]["changed"], x[0])))


def counts(rows: DataFrame) -> DataFrame:
    """One row of row counts."""
    return rows.agg(*count_columns())


def column_stats(rows: DataFrame, plan: Plan) -> DataFrame:
    """One row for each value column with a change: changed, match_rate, max and mean absolute difference. One aggregate."""
    spark = rows.sparkSession
    schema = "column_name string, numeric boolean, changed long, match_rate double, max_abs_diff double, mean_abs_diff double"
    if not plan.values:
        return spark.createDataFrame([], schema)
    one = rows.agg(*stat_columns(plan))
    per = F.array(*(F.struct(F.lit(v.name).alias("column_name"), F.lit(v.numeric).alias("numeric"), F.col(f"n{i}").alias("changed"), F.col(f"max{i}").alias("max_abs_diff"), F.col(f"mean{i}").alias("mean_abs_diff")) for i, v in enumerate(plan.values)))
    flat = one.select("compared", F.inline(per)).where("changed > 0")
    return flat.select("column_name", "numeric", "changed", F.when(F.col("compared") == 0, 1.0).otherwise(1 - F.col("changed") / F.col("compared")).alias("match_rate"), "max_abs_diff", "mean_abs_diff")


def _value(f: Field, name: str, kind: Kind) -> Column:
    return masked(shown(F.col(name), kind)) if f.masked else typed(F.col(name), f.domain)


def named(rows: DataFrame, plan: Plan) -> DataFrame:
    """Differing rows under the user's names: keys, diff_status, then <column>__left and <column>__right by column name."""
    cols = [_value(f, f"k{i}", Kind.FLOAT if f.domain is Domain.FLOAT else f.left.kind).alias(f.name) for i, f in enumerate(plan.keys)] + [F.col("status").alias("diff_status")]
    for i, f in enumerate(plan.values):
        cols += [_value(f, f"l{i}", f.left.kind).alias(f"{f.name}__left"), _value(f, f"r{i}", f.right.kind).alias(f"{f.name}__right")]
    return rows.where(F.col("status").isin(ADDED, REMOVED, CHANGED)).select(*cols)


def key_shown(plan: Plan) -> Column:
    parts = []
    for i, f in enumerate(plan.keys):
        text = shown(F.col(f"k{i}"), Kind.FLOAT if f.domain is Domain.FLOAT else f.left.kind)
        parts.append(masked(text) if f.masked else text)
    return key_text(parts)


def examples(rows: DataFrame, plan: Plan, limit: int) -> DataFrame:
    """Up to ``limit`` rows of each kind of difference, first by key as text: status, key, columns (name, left, right)."""
    text = lambda i, s, f: masked(shown(F.col(f"{s}{i}"), (f.left if s == "l" else f.right).kind)) if f.masked else shown(F.col(f"{s}{i}"), (f.left if s == "l" else f.right).kind)
    if plan.keys:
        cells = [F.when(F.col(f"d{i}"), F.struct(F.lit(f.name).alias("column"), text(i, "l", f).alias("left"), text(i, "r", f).alias("right"))) for i, f in enumerate(plan.values)]
        key = key_shown(plan)
    else:
        cells = []
        key = key_text([F.coalesce(text(i, "l", f), text(i, "r", f)) for i, f in enumerate(plan.values)])
    changes = F.filter(F.array(*cells), lambda x: x.isNotNull()) if cells else F.array().cast("array<struct<column:string,left:string,right:string>>")
    out = None
    for s in (ADDED, REMOVED, CHANGED):
        part = rows.where(F.col("status") == s).select("status", key.alias("key"), changes.alias("columns")).orderBy("key").limit(limit)
        out = part if out is None else out.unionByName(part)
    return out
