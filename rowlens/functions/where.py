"""Row filters: ``column OP literal`` or ``column IS [NOT] NULL``, joined by AND. There is no OR.

Null satisfies only IS NULL, NaN only ``!=``, text is ordered by its bytes. Literals take the column's type; one that
doesn't fit, or an unknown column, is refused."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowlens.errors import DiffError
from rowlens.functions.canon import micros, quoted
from rowlens.plans import schema
from rowlens.plans.types import Kind

OPERATORS = {"=": "=", "==": "=", "!=": "!=", "<>": "!=", "<": "<", "<=": "<=", ">": ">", ">=": ">="}
_TOKEN = re.compile(r"""\s*(?:('(?:[^']|'')*')|("(?:[^"]|"")*")|(<=|>=|<>|!=|==|=|<|>)|([^\s'"<>=!]+|!))""")
_TRUE, _FALSE = ("true", "t", "1", "yes"), ("false", "f", "0", "no")


@dataclass(frozen=True)
class Predicate:
    column: str
    op: str  # one of OPERATORS' values, 'null' or 'not null'
    literal: str = ""

    def __str__(self) -> str:
        if "null" in self.op:
            return f"{self.column} is {self.op}"
        return f"{self.column} {self.op} '{self.literal.replace(chr(39), chr(39) * 2)}'"


def _tokens(spec: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(spec.rstrip()):
        m = _TOKEN.match(spec, at)
        if not m:
            raise DiffError(f"where: can't read {spec[at:].strip()!r}")
        at = m.end()
        single, double, op, bare = m.groups()
        if single or double:
            q = (single or double)[0]
            out.append(("quoted", (single or double)[1:-1].replace(q + q, q)))
        else:
            out.append(("op", op) if op else ("bare", bare))
    return out


def parse(specs: str | list[str] | None) -> list[Predicate]:
    out: list[Predicate] = []
    for spec in [specs] if isinstance(specs, str) else specs or []:
        parts: list[list[tuple[str, str]]] = [[]]
        for t in _tokens(spec):
            if t[0] == "bare" and t[1].lower() == "and":
                parts.append([])
            else:
                parts[-1].append(t)
        out += [_one(p, spec) for p in parts]
    return out


def _one(t: list[tuple[str, str]], spec: str) -> Predicate:
    words = [x.lower() if kind == "bare" else None for kind, x in t]
    ops = [i for i, (kind, _) in enumerate(t) if kind == "op"]
    name = lambda part: " ".join(x for _, x in part)
    if not ops and len(t) >= 3 and words[-2:] == ["is", "null"]:
        return Predicate(name(t[:-2]), "null")
    if not ops and len(t) >= 4 and words[-3:] == ["is", "not", "null"]:
        return Predicate(name(t[:-3]), "not null")
    if len(ops) != 1 or not 0 < ops[0] < len(t) - 1:
        raise DiffError(f"where: expected column, operator and literal in {spec!r}")
    i = ops[0]
    if any(w in ("or", "||") for w in words):
        raise DiffError("where: there is no OR; conditions are joined by AND")
    return Predicate(name(t[:i]), OPERATORS[t[i][1]], name(t[i + 1 :]))


def _instant(text: str) -> int:
    """Microseconds since the epoch of a timestamp literal, or the count itself."""
    if re.fullmatch(r"[+-]?\d+", text):
        return int(text)
    m = re.fullmatch(r"(\d{4}-\d\d-\d\d)(?:[T ](\d\d:\d\d:\d\d)(?:\.(\d{1,9}))?)?\s*(Z|[+-]\d\d:?\d\d)?", text)
    if not m:
        raise ValueError(text)
    at = datetime.fromisoformat(f"{m[1]}T{m[2] or '00:00:00'}").replace(tzinfo=timezone.utc)
    us = int((at - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1)) + int((m[3] or "0").ljust(6, "0")[:6])
    if m[4] and m[4] != "Z":
        h, minutes = int(m[4][1:3]), int(m[4][-2:])
        us -= (1 if m[4][0] == "+" else -1) * (h * 60 + minutes) * 60_000_000
    return us


def bind(p: Predicate, columns: dict[str, schema.Column]) -> Column:
    c = columns.get(p.column)
    if c is None:
        raise DiffError(f"where: no column {p.column!r}")
    col = quoted(p.column)
    if p.op == "null":
        return col.isNull()
    if p.op == "not null":
        return col.isNotNull()
    try:
        value, col = _literal(p.literal, c.kind, col)
    except (ValueError, OverflowError):
        raise DiffError(f"where: {p.literal!r} does not fit column {p.column!r} of type {c.kind.value}") from None
    test = {"=": col == value, "!=": col != value, "<": col < value, "<=": col <= value, ">": col > value, ">=": col >= value}[p.op]
    if c.kind is Kind.FLOAT:
        test = (F.isnan(col) | test) if p.op == "!=" else (~F.isnan(col) & test)
    return test


def _literal(text: str, kind: Kind, col: Column) -> tuple[Column, Column]:
    if kind is Kind.INT:
        if re.fullmatch(r"[+-]?\d+", text):
            n = int(text)
            if not -(1 << 63) <= n < 1 << 63:
                raise ValueError(text)
            return F.lit(n).cast("long"), col
        return F.lit(float(text)), col.cast("double")
    if kind is Kind.FLOAT:
        return F.lit(float(text)), col.cast("double")
    if kind is Kind.BOOL:
        low = text.lower()
        if low not in _TRUE + _FALSE:
            raise ValueError(text)
        return F.lit(low in _TRUE), col
    if kind is Kind.DATE:
        day = date(1970, 1, 1) + timedelta(days=int(text)) if re.fullmatch(r"[+-]?\d+", text) else date.fromisoformat(text)
        return F.lit(day), col
    if kind is Kind.TIMESTAMP:
        return F.lit(_instant(text)).cast("long"), micros(col)
    return (F.lit(text), col) if kind is Kind.STRING else (F.lit(text.encode()), col)


def condition(predicates: list[Predicate], columns: list[schema.Column]) -> Column:
    by_name = {c.name: c for c in columns}
    return reduce(lambda a, b: a & b, (bind(p, by_name) for p in predicates), F.lit(True))


def render(predicates: list[Predicate]) -> str:
    return " AND ".join(map(str, predicates))
