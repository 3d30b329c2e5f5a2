"""Baselines: a (key hash, row hash) pair of 16 bytes for each row, and a header that says how they were made.

Stored as a Parquet directory ``pairs`` and a one-line ``header`` text beside it, both written by Spark, so a baseline
can live wherever Spark writes."""

from __future__ import annotations

import json
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlens.errors import DiffError
from rowlens.functions import where
from rowlens.functions.canon import canonical, hash_of, quoted
from rowlens.operators import classified
from rowlens.plans.options import Options, Plan, build_plan, parse_tolerance
from rowlens.plans.schema import columns_of, compare

FORMAT = "rowlens-baseline-1"
_SETTINGS = ("float_precision", "ignore_case", "trim", "timestamp_precision")


def _plan(df: DataFrame, options: Options, key: list[str]) -> Plan:
    cols, _ = columns_of(df.schema)
    return build_plan(compare(cols, cols), replace(options, tolerance=None), cols, cols, key)


def pairs(df: DataFrame, plan: Plan) -> DataFrame:
    """kh, rh of every row; values in the order of their names."""
    c = lambda f: canonical(quoted(f.name), f.right.kind, f.domain, plan.options)
    return df.select(hash_of([c(f) for f in plan.keys]).alias("kh"), hash_of([c(f) for f in sorted(plan.values, key=lambda f: f.name)]).alias("rh"))


def write(df: DataFrame, path: str, options: Options, key: list[str]) -> dict:
    """Write a baseline of a (filtered) table; returns the header."""
    if parse_tolerance(options.tolerance) or options.rename or options.keyless:
        raise DiffError("a baseline takes no tolerance, rename or keyless")
    plan = _plan(df, options, key)
    hashed = pairs(df, plan)
    if options.on_dup == "error" and hashed.groupBy("kh").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        raise DiffError("baseline: keys repeat; see on-dup warn")
    hashed.write.mode("overwrite").parquet(f"{path}/pairs")
    header = {
        "format": FORMAT, "keys": key, "key_domains": [f.domain.value for f in plan.keys], "values": sorted(f.name for f in plan.values),
        "value_domains": [f.domain.value for f in sorted(plan.values, key=lambda f: f.name)], "where": where.render(where.parse(options.where)),
        "rows": df.sparkSession.read.parquet(f"{path}/pairs").count(), **{s: getattr(options, s) for s in _SETTINGS},
    }
    df.sparkSession.createDataFrame([(json.dumps(header),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    return header


def read_header(spark: SparkSession, path: str) -> dict:
    try:
        header = json.loads(spark.read.text(f"{path}/header").first()[0])
    except Exception as e:
        raise DiffError(f"{path} is not a baseline: {str(e)[:80]}") from None
    if header.get("format") != FORMAT:
        raise DiffError(f"{path} is not a baseline")
    return header


def compare_with(df: DataFrame, path: str, options: Options) -> tuple[DataFrame, Plan, dict]:
    """Rows (k0.., status) of a live table against a baseline: removed rows have no key, changed ones no columns."""
    header = read_header(df.sparkSession, path)
    if parse_tolerance(options.tolerance):
        raise DiffError("a baseline holds hashes; tolerance can't apply")
    for s in _SETTINGS:
        asked = getattr(options, s)
        if asked and asked != header[s]:
            raise DiffError(f"the baseline was made with {s} {header[s]!r}, not {asked!r}")
    asked = where.render(where.parse(options.where))
    if asked != header["where"]:
        raise DiffError(f"the baseline was made with where {header['where']!r}, not {asked!r}")
    options = replace(options, ignore_columns=options.ignore_columns, **{s: header[s] for s in _SETTINGS})
    plan = _plan(df, options, header["keys"])
    values = sorted(plan.values, key=lambda f: f.name)
    if [f.name for f in values] != header["values"] or [f.domain.value for f in values] != header["value_domains"] or [f.domain.value for f in plan.keys] != header["key_domains"]:
        raise DiffError("the baseline's columns or their types are not this table's")
    base = df.sparkSession.read.parquet(f"{path}/pairs")
    if (n := base.count()) != header["rows"]:
        raise DiffError(f"the baseline is cut off: {n} of {header['rows']} rows")
    if options.on_dup == "error":
        for side, name in ((base, "baseline"), (pairs(df, plan), "table")):
            if side.groupBy("kh").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
                raise DiffError(f"keys repeat in the {name}; see on-dup warn")
    c = lambda f: canonical(quoted(f.name), f.right.kind, f.domain, plan.options)
    live = df.select(*(quoted(f.name).alias(f"k{i}") for i, f in enumerate(plan.keys)), hash_of([c(f) for f in plan.keys]).alias("kh"), hash_of([c(f) for f in values]).alias("rh"))
    joined = base.select(F.col("kh").alias("bk"), F.col("rh").alias("bh")).join(live, F.col("bk") == F.col("kh"), "full_outer")
    status = F.when(F.col("bk").isNull(), classified.ADDED).when(F.col("kh").isNull(), classified.REMOVED).when(F.col("bh") == F.col("rh"), classified.UNCHANGED).otherwise(classified.CHANGED)
    return joined.select(*(f"k{i}" for i in range(len(plan.keys))), status.alias("status")), plan, header
