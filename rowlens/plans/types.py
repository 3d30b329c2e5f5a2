"""Logical types: what columns are compared as, whatever stores them."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import types as T


class Kind(str, Enum):
    BOOL, INT, FLOAT, STRING, BYTES, TIMESTAMP, DATE = "bool", "int64", "float64", "string", "bytes", "timestamp", "date"


class Domain(str, Enum):
    """How two columns are compared: as they are, as doubles, as text or as bytes."""

    EXACT, FLOAT, TEXT, BYTES = "exact", "float", "text", "bytes"


NUMERIC = (Kind.INT, Kind.FLOAT)
_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def kind_of(t: T.DataType) -> Kind | None:
    """The logical type of a Spark type; None where columns of that type are left out of comparisons.

    Decimals that fit a 64-bit integer are compared as doubles; wider ones, and all nested types, are left out."""
    if isinstance(t, T.BooleanType):
        return Kind.BOOL
    if isinstance(t, _INTS):
        return Kind.INT
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return Kind.FLOAT
    if isinstance(t, T.DecimalType):
        return Kind.FLOAT if t.precision <= 18 else None
    if isinstance(t, (T.StringType, T.CharType, T.VarcharType)):
        return Kind.STRING
    if isinstance(t, T.BinaryType):
        return Kind.BYTES
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return Kind.TIMESTAMP
    return Kind.DATE if isinstance(t, T.DateType) else None


def domain_of(left: Kind, right: Kind) -> Domain | None:
    """The domain in which two kinds compare; None if they don't."""
    pair = {left, right}
    if left == right:
        return {Kind.FLOAT: Domain.FLOAT, Kind.STRING: Domain.TEXT, Kind.BYTES: Domain.BYTES}.get(left, Domain.EXACT)
    if pair == {Kind.INT, Kind.FLOAT}:
        return Domain.FLOAT
    return Domain.BYTES if pair == {Kind.STRING, Kind.BYTES} else None
