"""One format at a time: Parquet, CSV/TSV and NDJSON, with type inference for text.

Text is read as strings once. A column's type is inferred from a sample; values that contradict it later are found in
one aggregate over all columns, and such columns are planned again as text."""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowlens.errors import DiffError
from rowlens.functions.canon import quoted
from rowlens.sources import fs

TEXT = {".csv": ",", ".tsv": "\t"}
JSON = (".ndjson", ".jsonl")
PACKED = (".gz", ".zst")
#: Stricter than casts: no blanks, no type suffixes.
INT = r"^[+-]?[0-9]+$"
FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
WORDS = r"(?i)^([+-]?inf(inity)?|nan)$"
HEX_FLOAT = r"^[+-]?0[xX]([0-9a-fA-F]+\.?[0-9a-fA-F]*|\.[0-9a-fA-F]+)[pP][+-]?[0-9]+$"
DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
STAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?(Z|[+-][0-9]{2}:?[0-9]{2})?$"
#: The column that holds a row's file where files are read together.
PATH = "__path"
LADDER = ("bool", "long", "double", "date", "timestamp")


def extension(path: str) -> str:
    """The format's extension, compression dropped; empty if the format is unknown."""
    base = os.path.basename(path.rstrip("/")).lower()
    stem, ext = os.path.splitext(base)
    packed = ext in PACKED
    if packed:
        ext = os.path.splitext(stem)[1]
    return ext if ext in TEXT or ext in JSON or ext == ".parquet" and not packed else ""


def unpacked(path: str, start: bytes, most: int) -> bytes:
    """What the first bytes of a file hold, at most ``most`` bytes of it; nothing if they can't be unpacked."""
    if not path.endswith(PACKED):
        return start
    try:
        if path.endswith(".gz"):
            return zlib.decompressobj(31).decompress(start, most)
        return pa.CompressedInputStream(pa.BufferReader(start), "zstd").read(1 << 16)
    except (zlib.error, OSError):
        return b""


def delimiter_of(spec: str, default: str) -> str:
    if not spec:
        return default
    d = "\t" if spec in ("\\t", "tab", "\t") else spec
    if len(d) != 1 or ord(d) > 127:
        raise DiffError(f"delimiter: {spec!r} is not one ASCII character")
    return d


def value_as(c: Column, kind: str) -> Column:
    """Text as a value of the kind; null where it does not fit."""
    if kind == "bool":
        return F.when(c.isin("true", "True", "TRUE"), True).when(c.isin("false", "False", "FALSE"), False)
    if kind == "long":
        return F.when(c.rlike(INT), c.try_cast("long"))
    if kind == "double":
        low = F.lower(F.ltrim(F.regexp_replace(c, r"^[+-]", "")))
        special = F.when(low == "nan", F.lit(float("nan"))).when(c.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
        d = c.try_cast("double")
        finite = F.when(F.abs(d) < F.lit(float("inf")), d)
        return F.when(c.rlike(FLOAT), finite).when(c.rlike(WORDS) & ~((low == "nan") & c.rlike(r"^[+-]")), special).when(c.rlike(HEX_FLOAT), _hex_float(c))
    if kind == "date":
        return F.when(c.rlike(DATE), c.try_cast("date"))
    if kind == "timestamp":
        cut = F.regexp_replace(F.regexp_replace(c, r"(\.[0-9]{6})[0-9]+", "$1"), r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")
        zoned = F.when(cut.rlike(r"(Z|[+-][0-9]{2}:[0-9]{2})$"), cut).otherwise(F.concat(cut, F.lit("Z")))
        short = c.endswith("Z") & (F.length(c) <= 27)  # nothing to cut, and most values: three patterns less for each
        return F.when(c.rlike(STAMP), F.when(short, c).otherwise(zoned).try_cast("timestamp"))
    return c


def _hex_float(c: Column) -> Column:
    whole, part = F.regexp_extract(c, r"0[xX]([0-9a-fA-F]*)", 1), F.regexp_extract(c, r"\.([0-9a-fA-F]*)", 1)
    mantissa = F.conv(F.concat(whole, part), 16, 10).try_cast("double")
    power = F.regexp_extract(c, r"[pP]([+-]?[0-9]+)$", 1).try_cast("double") - 4 * F.length(part)
    return mantissa * F.pow(F.lit(2.0), power) * F.when(c.startswith("-"), -1.0).otherwise(1.0)


def _ladder(names: list[str]) -> list[Column]:
    """Of each column: full values, empty ones, and those that don't fit each kind."""
    aggs = []
    for i, n in enumerate(names):
        full = quoted(n).isNotNull() & (quoted(n) != "")
        aggs += [F.count_if(full).alias(f"n{i}"), F.count_if(~full | quoted(n).isNull()).alias(f"e{i}")]
        aggs += [F.count_if(full & value_as(quoted(n), k).isNull()).alias(f"b{i}_{k}") for k in LADDER]
    return aggs


def _kind(row, i: int) -> str:
    return next((k for k in LADDER if row[f"b{i}_{k}"] == 0), "string") if row[f"n{i}"] else "string"


def infer(df: DataFrame, names: list[str], rows: int) -> dict[str, tuple[str, bool]]:
    """(kind, nullable) of text columns: the narrowest that all non-empty sampled values fit, in one aggregate."""
    row = (df if rows < 0 else df.limit(rows or 1000)).agg(*_ladder(names)).first()
    return {n: (_kind(row, i), bool(row[f"e{i}"])) for i, n in enumerate(names)}


def first_rows(df: DataFrame, rows: int) -> DataFrame:
    """The first rows of each split (all if ``rows`` is negative); a split is not read beyond the batch they are in."""
    most = rows or 1000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = most
        for b in batches:
            yield b.slice(0, left)
            left -= b.num_rows
            if left <= 0:
                return

    return df if rows < 0 else df.mapInArrow(run, df.schema)


@contextmanager
def files_apart(spark: SparkSession) -> Iterator[None]:
    """Splits of jobs that run inside hold no two files."""
    option = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(option)
    try:
        spark.conf.set(option, spark.conf.get("spark.sql.files.maxPartitionBytes"))
        yield
    finally:
        spark.conf.set(option, before)


def infer_by_file(raw: DataFrame, names: list[str], rows: int) -> dict[str, tuple[str, bool]]:
    """As :func:`infer`, file by file over the first rows of each split of a tagged table, the files' kinds united."""
    with files_apart(raw.sparkSession):
        found = first_rows(raw, rows).groupBy(PATH).agg(*_ladder(names)).orderBy(PATH).collect()
    out: dict[str, tuple[str, bool]] = {}
    for row in found:
        for i, n in enumerate(names):
            kind, (was, null) = _kind(row, i), out.get(n, (_kind(row, i), False))
            if was != kind and {was, kind} != {"long", "double"}:
                raise DiffError(f"column {n!r} is {was} in one file and {kind} in another ({row[PATH]})")
            out[n] = (kind if was == kind else "double", null or bool(row[f"e{i}"]))
    return out or dict.fromkeys(names, ("string", False))  # no file has rows


def typed_columns(raw: DataFrame, kinds: dict[str, tuple[str, bool]], empty_is_text: bool) -> DataFrame:
    cols = [F.col(PATH)] if PATH in raw.columns else []
    for n, (kind, nullable) in kinds.items():
        c = quoted(n)
        value = (F.coalesce(c, F.lit("")) if empty_is_text else c) if kind == "string" else value_as(c, kind)
        cols.append(value.alias(n, metadata={"nullable": nullable}))
    return raw.select(*cols)


def contradictions(raw: DataFrame, kinds: dict[str, tuple[str, bool]]) -> set[str]:
    """Columns with a value that their inferred type does not fit."""
    some = [(n, k) for n, (k, _) in kinds.items() if k != "string"]
    if not some:
        return set()
    row = raw.agg(*(F.count_if(quoted(n).isNotNull() & (quoted(n) != "") & value_as(quoted(n), k).isNull()).alias(f"b{i}") for i, (n, k) in enumerate(some))).first()
    return {n for i, (n, _) in enumerate(some) if row[f"b{i}"]}


def read_text(spark: SparkSession, paths: list[str], delimiter: str, tag: bool = False) -> DataFrame:
    """CSV as strings. A record of the wrong length fails the scan; quoted fields may span lines.

    Files without any quote are split, so one file is read by many tasks; with one, a file is read whole, since a line
    break may stand inside quotes. One pass over the bytes tells them apart (packed files can't be split anyway)."""
    first = spark.read.text(paths[0]).limit(1).collect()
    if not first or not first[0][0].lstrip("\ufeff"):
        raise DiffError(f"{paths[0]}: no header")
    spark.conf.set("spark.sql.csv.parser.columnPruning.enabled", "false")  # else records of the wrong length pass
    read = spark.read.option("header", True).option("sep", delimiter).option("escape", '"').option("multiLine", True).option("mode", "FAILFAST").option("enforceSchema", False)
    names = read.csv(paths[0]).limit(0).columns
    stripped = [re.sub(r"^\ufeff", "", n) for n in names]
    header = _header(first[0][0].lstrip("\ufeff"), delimiter)
    if header is not None and len(set(header)) != len(header):
        raise DiffError(f"{paths[0]}: a column name stands twice in the header")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in stripped])
    splits = not any(p.endswith(PACKED) for p in paths) and not spark.read.text(paths).where(F.col("value").contains('"') | F.col("value").contains("\r")).limit(1).count()
    df = read.schema(schema).option("multiLine", not splits).csv(paths)
    return df.select("*", F.col("_metadata.file_path").alias(PATH)) if tag else df


def _header(line: str, delimiter: str) -> list[str] | None:
    """Names of a header that fits one line."""
    import csv

    return next(csv.reader([line], delimiter=delimiter), None) if line.count('"') % 2 == 0 else None


def _json_lines(spark: SparkSession, paths: list[str], tag: bool) -> DataFrame:
    """Lines that are not blank; with ``tag`` also each one's file."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    path = [F.col("_metadata.file_path").alias(PATH)] if tag else []
    return spark.read.text(paths).where(F.trim("value") != "").select(F.col("value").alias("line"), *path)


def _json_kind(r) -> str:
    """The narrowest kind of a key's sampled values; empty for nested ones."""
    seen = {k for k in r["kinds"] if k != "VOID"}
    if seen & {"OBJECT", "ARRAY"}:
        return ""
    if seen == {"STRING"}:
        return "timestamp" if r["stamps"] else "date" if r["dates"] else "string"
    if seen == {"BOOLEAN"}:
        return "bool"
    if seen and not seen & {"STRING", "BOOLEAN"}:
        return "long" if seen == {"BIGINT"} and r["whole"] else "double"
    return "string"


def infer_json(lines: DataFrame, name: str) -> dict[str, tuple[dict[str, tuple[str, bool]], list[str]]]:
    """For each file of sampled lines (one without a tag) the kinds of its keys and warnings for nested columns; files without records are left out."""
    spark, tagged = lines.sparkSession, PATH in lines.columns
    file = f"`{PATH}`" if tagged else "''"
    lines.select(F.try_parse_json("line").alias("v"), *([PATH] if tagged else [])).createOrReplaceTempView("__rowlens_lines")
    text = "try_variant_get(value, '$', 'string')"
    totals = spark.sql(f"select {file} file, count(*) n, count_if(v is null or schema_of_variant(v) not like 'OBJECT%') bad from __rowlens_lines group by all order by file").collect()
    for r in totals:
        if r["bad"]:
            raise DiffError(f"{r['file'] or name}: a line is not a JSON object")
    found = spark.sql(
        f"select {file} file, key, collect_set(regexp_replace(schema_of_variant(value), '[(<].*', '')) kinds, count(*) n, "
        f"bool_and(coalesce({text} rlike '" + STAMP.replace("\\", "\\\\") + f"', true)) stamps, bool_and(coalesce({text} rlike '" + DATE + f"', true)) dates, "
        f"bool_and(coalesce({text} rlike '^[+-]?[0-9]+$', true)) whole from __rowlens_lines, lateral variant_explode(v) group by all order by file, key"
    ).collect()
    spark.catalog.dropTempView("__rowlens_lines")
    total = {r["file"]: r["n"] for r in totals}
    out: dict = {f: ({}, []) for f in total}
    for r in found:
        kinds, warnings = out[r["file"]]
        if kind := _json_kind(r):
            kinds[r["key"]] = (kind, r["n"] < total[r["file"]] or "VOID" in r["kinds"])
        else:
            warnings.append(f"column {r['key']!r} skipped: nested values are not compared")
    for f, (kinds, _) in out.items():
        if not kinds:
            raise DiffError(f"{f or name}: no column can be compared")
    return out


def json_groups(spark: SparkSession, paths: list[str], rows: int) -> list[tuple[list[str], dict[str, tuple[str, bool]], list[str]]]:
    """Files whose keys have the same kinds in the first lines of each split, so that they can be read together; files
    without records (which a writer leaves for an empty partition) are in none."""
    with files_apart(spark):
        found = infer_json(first_rows(_json_lines(spark, paths, True), rows), paths[0])
    if not found:
        raise DiffError(f"{paths[0]}: no records")
    known = {fs.qualified(p): p for p in paths}
    groups: dict = {}
    for f, (kinds, warnings) in found.items():
        some, united, warned = groups.setdefault(tuple((k, kind) for k, (kind, _) in kinds.items()), ([], {}, warnings))
        some.append(known[fs.qualified(f, encoded=True)])
        united |= {k: (kind, null or united.get(k, ("", False))[1]) for k, (kind, null) in kinds.items()}
        warned += [w for w in warnings if w not in warned]
    return list(groups.values())


def read_json(spark: SparkSession, paths: list[str], rows: int, tag: bool = False, found=None) -> tuple[DataFrame, dict[str, tuple[str, bool]], list[str]]:
    """NDJSON as strings under its sampled keys, their kinds, and warnings for nested columns (found: both, if they are known)."""
    lines = _json_lines(spark, paths, tag)
    if found is None:
        found = infer_json(lines if rows < 0 else lines.limit(rows or 1000), paths[0]).get("")
        if not found:
            raise DiffError(f"{paths[0]}: no records")
    kinds, warnings = found
    parsed = lines.select(F.try_parse_json("line").alias("v"), "line", *([PATH] if tag else []))
    at = lambda k: "$['" + k.replace("'", "\\'") + "']"

    def get(k: str) -> Column:
        """The value as text; a nested one, which the sample did not show, fails the scan."""
        text = F.try_variant_get("v", at(k), "string")
        nested = (text.startswith("{") | text.startswith("[")) & F.schema_of_variant(F.try_variant_get("v", at(k), "variant")).rlike("^(OBJECT|ARRAY)")
        return F.when(nested, F.raise_error(F.lit(f"column {k!r} holds a nested value")).cast("string")).otherwise(text)

    broken = F.when(F.col("v").isNull(), F.raise_error(F.concat(F.lit("malformed JSON: "), F.substring("line", 1, 80))))
    return parsed.select(*(F.coalesce(broken.cast("string"), get(k)).alias(k) for k in kinds), *([PATH] if tag else [])), kinds, warnings


def read_parquet(spark: SparkSession, paths: list[str], tag: bool = False) -> DataFrame:
    """Parquet with footers' nullability and physical types where the driver can read a footer."""
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    df = spark.read.parquet(*paths)
    meta = footer(paths[0])
    cols = [F.col("_metadata.file_path").alias(PATH)] if tag else []
    for f in df.schema.fields:
        c, m = quoted(f.name), meta.get(f.name)
        if m is None:
            cols.append(c.alias(f.name))
            continue
        if m["nanos"]:
            c = F.timestamp_micros(F.floor(c / 1000))
        cols.append(c.alias(f.name, metadata={k: m[k] for k in ("physical", "nullable", "skip") if k in m}))
    return df.select(*cols)


def footer(path: str) -> dict[str, dict]:
    """Name to physical type, nullability and flags of a file's flat columns."""
    if fs.is_dir(path):
        parts = [x for x in fs.walk(path) if x.endswith(".parquet") and os.path.basename(x)[0] not in "._"]
        return footer(parts[0]) if parts else {}
    if not fs.is_file(path):
        return {}
    import pyarrow.parquet as pq

    try:
        schema = pq.ParquetFile(fs.local(path) if fs.is_local(path) else pa.BufferReader(fs.tail(path))).schema
    except Exception as e:
        raise DiffError(f"{path}: {str(e)[:120]}") from None
    out = {}
    for i in range(len(schema)):
        c = schema.column(i)
        if "." in c.path:
            continue
        logical = str(c.logical_type)
        out[c.name] = {"physical": c.physical_type if logical in ("None", "") else f"{c.physical_type}/{logical.split('(')[0]}", "nullable": c.max_definition_level > 0, "nanos": "timeUnit=nanoseconds" in logical}
        if logical.startswith("Decimal") and c.physical_type not in ("INT32", "INT64"):
            out[c.name]["skip"] = True
    return out


def schema_text(path: str) -> str:
    """A Parquet file's schema, to be compared; of a remote file all that is read is its end."""
    import pyarrow.parquet as pq

    try:
        if fs.is_local(path):
            return str(pq.read_schema(fs.local(path)).remove_metadata())
        return str(pq.read_schema(pa.BufferReader(fs.tail(path))).remove_metadata())
    except Exception as e:
        raise DiffError(f"{path}: {str(e)[:120]}") from None


def row_count(path: str) -> int | None:
    import pyarrow.parquet as pq

    local = path.removeprefix("file://")
    return pq.read_metadata(local).num_rows if os.path.isfile(local) else None
