"""Schemas side by side: what was added, removed, retyped, and what can be compared."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from rowlens.errors import DiffError
from rowlens.plans.types import Domain, Kind, domain_of, kind_of


@dataclass(frozen=True)
class Column:
    name: str
    kind: Kind
    nullable: bool = True
    physical: str = ""

    def render(self) -> str:
        return f"{self.kind.value} ({self.physical})" if self.physical else self.kind.value


def columns_of(schema: T.StructType) -> tuple[list[Column], list[str]]:
    """The comparable columns of a schema, and a warning for each that is left out.

    A field's metadata may carry ``physical`` (as stored) and ``nullable`` (as declared, which readers hide)."""
    cols, warnings = [], []
    for f in schema.fields:
        k = kind_of(f.dataType)
        if k is None or f.metadata.get("skip"):
            warnings.append(f"column {f.name!r} skipped: {f.dataType.simpleString()} is not compared")
        else:
            cols.append(Column(f.name, k, f.metadata.get("nullable", f.nullable), f.metadata.get("physical", "")))
    if not cols:
        raise DiffError("no column can be compared")
    return cols, warnings


@dataclass
class SchemaDiff:
    added_columns: list[dict] = field(default_factory=list)
    removed_columns: list[dict] = field(default_factory=list)
    type_changes: list[dict] = field(default_factory=list)
    nullability_changes: list[dict] = field(default_factory=list)
    renames: list[dict] = field(default_factory=list)
    common: list[tuple[Column, Column, Domain]] = field(default_factory=list)

    @property
    def same(self) -> bool:
        return not (self.added_columns or self.removed_columns or self.type_changes or self.nullability_changes)

    def as_dict(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k != "common"}


def compare(left: list[Column], right: list[Column], renames: dict[str, str] | None = None) -> SchemaDiff:
    """Columns by name, case-sensitively and whatever their order; ``common`` keeps the left order."""
    out = SchemaDiff(renames=[{"left": n, "right": o} for o, n in (renames or {}).items() if o != n])
    on_left, on_right = {c.name: c for c in left}, {c.name: c for c in right}
    out.added_columns = [{"name": c.name, "type": c.render()} for c in right if c.name not in on_left]
    for a in left:
        b = on_right.get(a.name)
        if b is None:
            out.removed_columns.append({"name": a.name, "type": a.render()})
            continue
        d = domain_of(a.kind, b.kind)
        if a.kind != b.kind:
            out.type_changes.append({"column": a.name, "left": a.render(), "right": b.render(), "comparable": d is not None})
        if a.nullable != b.nullable:
            out.nullability_changes.append({"column": a.name, "left_nullable": a.nullable, "right_nullable": b.nullable})
        if d is not None:
            out.common.append((a, b, d))
    return out


def check_renames(left: list[str], right: list[str], renames: dict[str, str]) -> dict[str, str]:
    """Renames from right names to left names that take effect; unknown names and collisions are refused."""
    out, targets = {}, set()
    for old, new in renames.items():
        if old not in right:
            raise DiffError(f"rename: the right side has no column {old!r}")
        if new not in left:
            raise DiffError(f"rename: the left side has no column {new!r}")
        if old == new:
            continue
        if new in targets or new in right and new not in renames:
            raise DiffError(f"rename: the right side would have two columns {new!r}")
        targets.add(new)
        out[old] = new
    return out


def rename(df: DataFrame, renames: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(renames) if renames else df


def schema_rows(spark: SparkSession, diff: SchemaDiff) -> DataFrame:
    """A schema diff as rows (column, change, left, right)."""
    rows = [(c["name"], "added", None, c["type"]) for c in diff.added_columns] + [(c["name"], "removed", c["type"], None) for c in diff.removed_columns]
    rows += [(c["column"], "type" if c["comparable"] else "incomparable", c["left"], c["right"]) for c in diff.type_changes]
    rows += [(c["column"], "nullability", str(c["left_nullable"]).lower(), str(c["right_nullable"]).lower()) for c in diff.nullability_changes]
    rows += [(r["left"], "rename", r["left"], r["right"]) for r in diff.renames]
    return spark.createDataFrame(rows, "column_name string, change string, left_value string, right_value string")
