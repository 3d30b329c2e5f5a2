"""Options of a comparison and the plan they resolve to. All refusals that need no data are made here."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from rowlens.errors import DiffError
from rowlens.plans.schema import Column, SchemaDiff
from rowlens.plans.types import NUMERIC, Domain

PRECISIONS = {"s": 1_000_000, "sec": 1_000_000, "second": 1_000_000, "ms": 1000, "millisecond": 1000, "us": 1, "microsecond": 1}
ON_DUP, MODES = ("error", "warn", "match"), ("auto", "memory", "stream")


@dataclass(frozen=True)
class Bound:
    """A difference d of a and b is covered if d <= absolute, or d <= relative * max(|a|, |b|); 0 switches a bound off."""

    absolute: float = 0.0
    relative: float = 0.0


@dataclass
class Tolerance:
    default: Bound | None = None
    columns: dict[str, Bound] = field(default_factory=dict)

    def __bool__(self) -> bool:
        return self.default is not None or bool(self.columns)


def _bound(spec: str) -> Bound:
    found: dict[str, float] = {}
    for part in spec.split(","):
        name, eq, text = part.strip().partition("=")
        name, text = (name.strip(), text.strip()) if eq else ("abs", name)
        if name not in ("abs", "rel") or name in found:
            raise DiffError(f"tolerance: can't read {part.strip()!r}")
        try:
            x = float(text)
        except ValueError:
            raise DiffError(f"tolerance: {text!r} is not a number") from None
        if not math.isfinite(x) or x < 0:
            raise DiffError(f"tolerance: {text!r} has to be finite and not negative")
        found[name] = x
    if not any(found.values()):
        raise DiffError("tolerance: a bound above 0 is needed")
    return Bound(found.get("abs", 0.0), found.get("rel", 0.0))


def parse_tolerance(specs: str | list[str] | None) -> Tolerance:
    """``0.01``, ``0.01,rel=1e-6``, ``rel=..``, ``abs=..`` for all numeric columns, ``column=0.01[,rel=..]`` for one."""
    out = Tolerance()
    for spec in [specs] if isinstance(specs, str) else specs or []:
        name, eq, rest = spec.partition("=")
        if eq and name.strip() not in ("abs", "rel") and "," not in name:
            out.columns[name.strip()] = _bound(rest)
        else:
            out.default = _bound(spec)
    return out


def parse_budget(spec: str) -> tuple[str, float]:
    """('rows', n) or ('percent', p)."""
    s = spec.strip()
    if m := re.fullmatch(r"(\d+(?:\.\d*)?|\.\d+)\s*%", s):
        return "percent", float(m[1])
    if re.fullmatch(r"\d+", s):
        return "rows", float(s)
    raise DiffError(f"max-diff: {spec!r} is neither a count nor a percentage")


def allowed(budget: tuple[str, float], left_rows: int, right_rows: int) -> int:
    """The rows that may differ; percentages are of the larger side and truncate."""
    how, x = budget
    return int(x) if how == "rows" else int(x / 100 * max(left_rows, right_rows))


@dataclass
class Options:
    key: list[str] = field(default_factory=list)
    keyless: bool = False
    where: list[str] = field(default_factory=list)
    ignore_columns: list[str] = field(default_factory=list)
    rename: dict[str, str] = field(default_factory=dict)
    mask: list[str] = field(default_factory=list)
    float_precision: int = 0
    ignore_case: bool = False
    trim: bool = False
    timestamp_precision: str = ""
    tolerance: str | list[str] | None = None
    on_dup: str = "error"
    mode: str = "auto"
    summary: bool = False
    max_diff: str | None = None
    limit: int = 10
    output: str | None = None
    infer_rows: int = 1000
    delimiter: str = ""
    order_by: list[str] = field(default_factory=list)

    def check(self) -> None:
        if self.on_dup not in ON_DUP:
            raise DiffError(f"on-dup: {self.on_dup!r} is none of {', '.join(ON_DUP)}")
        if self.mode not in MODES:
            raise DiffError(f"mode: {self.mode!r} is none of {', '.join(MODES)}")
        if self.timestamp_precision and self.timestamp_precision not in PRECISIONS:
            raise DiffError(f"timestamp-precision: {self.timestamp_precision!r} is none of s, ms, us")
        if self.float_precision < 0 or self.limit < 0:
            raise DiffError("float-precision and limit can't be negative")
        if self.max_diff is not None:
            parse_budget(self.max_diff)
        tolerance = parse_tolerance(self.tolerance)
        if tolerance and self.summary:
            raise DiffError("tolerance needs the values of changed rows; summary does not read them")
        if self.summary and self.output:
            raise DiffError("output needs the differing rows; summary does not keep them")
        if self.output and not re.search(r"\.(csv|parquet)$", self.output):
            raise DiffError("output has to end in .csv or .parquet")
        if self.keyless:
            for bad, name in ((self.key, "key"), (tolerance, "tolerance"), (self.on_dup != "error", "on-dup"), (self.mode == "stream", "mode stream")):
                if bad:
                    raise DiffError(f"keyless compares whole rows and takes no {name}")

    def comparison(self) -> str:
        """The normalisation in words, for reports and baselines."""
        parts = [f"float precision {self.float_precision}"] if self.float_precision else []
        parts += ["ignoring case"] if self.ignore_case else []
        parts += ["trimmed"] if self.trim else []
        parts += [f"timestamps to {self.timestamp_precision}"] if self.timestamp_precision else []
        return ", ".join(parts)


@dataclass(frozen=True)
class Field:
    """A compared column: both sides' types, the domain they meet in, its tolerance, and whether its values are masked."""

    name: str
    left: Column
    right: Column
    domain: Domain
    bound: Bound | None = None
    masked: bool = False

    @property
    def numeric(self) -> bool:
        return self.domain is Domain.FLOAT or self.left.kind in NUMERIC


@dataclass
class Plan:
    keys: list[Field]
    values: list[Field]
    options: Options
    schema: SchemaDiff

    @property
    def tolerant(self) -> bool:
        return any(v.bound for v in self.values)


def build_plan(schema: SchemaDiff, options: Options, left: list[Column], right: list[Column], key: list[str] | None = None) -> Plan:
    """Keys, values, domains, tolerances and masks; errors name the side at fault. ``key`` overrides the options' key."""
    common = {a.name: (a, b, d) for a, b, d in schema.common}
    names_left, names_right = {c.name for c in left}, {c.name for c in right}
    keys = [] if options.keyless else list(key if key is not None else options.key)
    for k in keys:
        if k not in names_left:
            raise DiffError(f"key: the left side has no column {k!r}")
        if k not in names_right:
            raise DiffError(f"key: the right side has no column {k!r}")
        if k not in common:
            raise DiffError(f"key: the types of column {k!r} can't be compared")
    for m in options.mask:
        if m not in names_left | names_right:
            raise DiffError(f"mask: no column {m!r}")
    values = [n for n in common if n not in keys and n not in options.ignore_columns]
    tolerance = parse_tolerance(options.tolerance)

    def field_of(name: str, bound: Bound | None = None) -> Field:
        return Field(name, *common[name], bound, name in options.mask)

    for name in tolerance.columns:
        if name not in values or not field_of(name).numeric:
            raise DiffError(f"tolerance: {name!r} is not a compared numeric column")
    if options.keyless and not values:
        raise DiffError("keyless: no column can be compared")
    if not options.keyless and not keys:
        raise DiffError("a key is needed: none was given or could be inferred")
    fields = [field_of(n, tolerance.columns.get(n, tolerance.default if field_of(n).numeric else None)) for n in values]
    return Plan([field_of(k) for k in keys], fields, options, schema)
