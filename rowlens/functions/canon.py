"""Canonical values (what is compared) and displayed values (what is shown), as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowlens.plans.options import PRECISIONS, Options
from rowlens.plans.types import Domain, Kind

_SPACE = r"[\s\u000B\u0085\p{Z}]+"


def quoted(name: str) -> Column:
    """A column by its exact name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def rounded(c: Column, digits: int) -> Column:
    """Half-even on the scaled value; where scaling overflows, the value itself."""
    if digits <= 0:
        return c
    q = F.rint(c * F.lit(10.0**digits)) / F.lit(10.0**digits)
    return F.when(F.isnan(q) | (F.abs(q) == F.lit(float("inf"))), c).otherwise(q)


def _text(c: Column, o: Options) -> Column:
    if o.trim:
        c = F.regexp_replace(c, f"^{_SPACE}|{_SPACE}$", "")
    # per-character folding: a final sigma folds like any other, a dotted capital I to a plain one
    return F.lower(F.translate(c, "\u03a3\u0130", "\u03c3i")) if o.ignore_case else c


def canonical(c: Column, kind: Kind, domain: Domain, o: Options) -> Column:
    if domain is Domain.FLOAT:
        return rounded(c.cast("double"), o.float_precision)
    if domain is Domain.TEXT:
        return _text(c, o)
    if domain is Domain.BYTES:
        return _text(c.cast("string"), o).cast("binary") if o.trim or o.ignore_case else c.cast("binary")
    if kind is Kind.INT:
        return c.cast("long")
    if kind is Kind.TIMESTAMP:
        us, unit = micros(c), PRECISIONS.get(o.timestamp_precision, 1)
        return us - F.pmod(us, F.lit(unit)) if unit > 1 else us
    return c


def shown(c: Column, kind: Kind) -> Column:
    """Text of a value: as reports, masks and CSV exports show it. Null stays null."""
    if kind is Kind.FLOAT:
        d = c.cast("double")
        plain = F.regexp_replace(F.regexp_replace(F.format_string("%f", d), r"(\.\d*?)0+$", "$1"), r"\.$", "")
        return F.when(d.isNull(), None).when(F.isnan(d), "NaN").when(d == float("inf"), "+Inf").when(d == float("-inf"), "-Inf").otherwise(plain)
    if kind is Kind.BYTES:
        return F.concat(F.lit("0x"), F.lower(F.hex(c)))
    if kind is Kind.TIMESTAMP:
        return F.date_format(c.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return c.cast("string")


def key_text(parts: list[Column]) -> Column:
    """A key as one string."""
    return F.concat_ws("|", *(F.coalesce(p, F.lit("NULL")) for p in parts))


def hash_of(parts: list[Column]) -> Column:
    """A 64-bit hash in which nulls count, so that columns can't trade places with one another."""
    return F.xxhash64(*(x for p in parts for x in (F.isnull(p), p))) if parts else F.lit(0).cast("long")


def typed(c: Column, domain: Domain) -> Column:
    """A value as exported: coerced columns take the type of their domain."""
    return c.cast("double") if domain is Domain.FLOAT else c


__all__ = ["canonical", "hash_of", "key_text", "micros", "quoted", "rounded", "shown", "typed"]
