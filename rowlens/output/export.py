"""Differing rows as one CSV or Parquet file."""

from __future__ import annotations

import os
import shutil
import uuid

from pyspark.sql import DataFrame

from rowlens.errors import DiffError
from rowlens.functions.canon import quoted, shown
from rowlens.plans.options import Plan
from rowlens.plans.types import kind_of


def export(rows: DataFrame, path: str, plan: Plan) -> None:
    """Write ``rows`` (see ``classified.named``) to ``path``. CSV values are as shown, null is empty; Parquet keeps types.

    A path with a scheme becomes a directory of part files, which scales; a local path becomes one file."""
    csv = path.endswith(".csv")
    if not csv and not path.endswith(".parquet"):
        raise DiffError("output has to end in .csv or .parquet")
    if csv:
        rows = rows.select(*((shown(quoted(f.name), k) if (k := kind_of(f.dataType)) else quoted(f.name)).alias(f.name) for f in rows.schema.fields))
    else:
        rows = rows.select(*sorted(rows.columns))
    writer = lambda df: df.write.mode("overwrite").option("header", True).option("emptyValue", '""').option("escape", '"')
    if "://" in path:
        writer(rows).csv(path) if csv else writer(rows).parquet(path)
        return
    folder = f"{os.path.dirname(os.path.abspath(path))}/.{uuid.uuid4().hex}"
    try:
        writer(rows.coalesce(1)).csv(f"file://{folder}") if csv else writer(rows.coalesce(1)).parquet(f"file://{folder}")
        part = next(os.path.join(folder, x) for x in sorted(os.listdir(folder)) if x.startswith("part-"))
        os.replace(part, path)
    finally:
        shutil.rmtree(folder, ignore_errors=True)
