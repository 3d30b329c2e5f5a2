"""Key inference: columns without a repeated value in the first rows of both sides, by a score of name and type."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.errors import DiffError
from rowlens.functions.canon import quoted
from rowlens.plans.schema import SchemaDiff
from rowlens.plans.types import Kind

SAMPLE = 100_000
EXACT = ("id", "key", "pk", "uuid", "guid")


def score(name: str, kind: Kind) -> int:
    n = name.lower()
    return (100 if n in EXACT else 50 if n.endswith("id") else 0) + (10 if kind is Kind.INT else 5 if kind is Kind.STRING else 0)


def unique_columns(df: DataFrame, names: list[str], sample: int = SAMPLE) -> set[str]:
    """Columns whose sampled values are all distinct; null counts as one value."""
    some = df.select(*(quoted(n).alias(f"c{i}") for i, n in enumerate(names))).limit(sample)
    row = some.agg(F.count("*").alias("n"), *(x for i in range(len(names)) for x in (F.count(f"c{i}").alias(f"n{i}"), F.count_distinct(f"c{i}").alias(f"u{i}")))).first()
    return {name for i, name in enumerate(names) if row[f"n{i}"] == row[f"u{i}"] and row["n"] - row[f"n{i}"] <= 1}


def candidates(left: DataFrame, right: DataFrame, schema: SchemaDiff, sample: int = SAMPLE) -> list[tuple[str, int]]:
    """(column, score) of the usable columns, best first, ties in left order."""
    names = [a.name for a, _, _ in schema.common]
    if not names:
        return []
    good = unique_columns(left, names, sample) & unique_columns(right, names, sample)
    return sorted(((a.name, score(a.name, a.kind)) for a, _, _ in schema.common if a.name in good), key=lambda x: -x[1])


def infer_key(left: DataFrame, right: DataFrame, schema: SchemaDiff) -> str:
    found = candidates(left, right, schema)
    if not found:
        raise DiffError("no key: no common column is free of repeats on both sides; name one with key, or compare whole rows with keyless")
    return found[0][0]
