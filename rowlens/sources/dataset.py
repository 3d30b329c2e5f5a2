"""Open a path: a file, a directory, a glob, a lake table at a version, or a remote address."""

from __future__ import annotations

import os
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlens.errors import DiffError
from rowlens.functions.canon import quoted
from rowlens.functions.where import Predicate
from rowlens.plans.types import Kind, domain_of, kind_of
from rowlens.sources import formats, fs, lake, remote

#: Bytes of a text file in which its header has to end where files are grouped by header.
HEADER_BYTES = 1 << 20


@dataclass
class Dataset:
    """A table, what was left out of it, and how it was read (so that it can be read again)."""

    df: DataFrame
    warnings: list[str] = field(default_factory=list)
    raw: list[tuple[DataFrame, dict]] = field(default_factory=list)
    reopen: object = None
    files: list[tuple[str, dict]] = field(default_factory=list)
    subset: object = None  # the table of some of the files
    constant: frozenset = frozenset()  # columns whose value is a file's own

    def contradictions(self) -> set[str]:
        """Text columns that do not hold what their sample promised; one job for each text format."""
        return set().union(*(formats.contradictions(raw, kinds) for raw, kinds in self.raw))

    def retyped(self, names: set[str]) -> Dataset:
        return self.reopen(frozenset(names)) if self.reopen else self

    def pruned(self, predicates: list[Predicate]) -> tuple[Dataset, int]:
        """The table without the files whose constant partition values fail a predicate, and how many these are.

        Files in hive folders are left to Catalyst, which prunes them by the same values."""
        tests = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}

        def fails(p: Predicate, values: dict) -> bool:
            if p.column not in values or p.column not in self.constant:
                return False
            return p.op == "null" or p.op in tests and not tests[p.op](values[p.column].encode(), p.literal.encode())

        gone = {path for path, values in self.files if any(fails(p, values) for p in predicates)}
        if not gone or self.subset is None:
            return self, len(gone)
        left = [path for path, _ in self.files if path not in gone]
        return replace(self, df=self.subset(set(left)) if left else self.df.limit(0)), len(gone)


def hive_values(path: str, root: str) -> dict[str, str]:
    """k=v segments between a root and a file, verbatim."""
    inside = os.path.relpath(os.path.dirname(fs.plain(path)), fs.plain(root)).split(os.sep)
    return {k: v for k, eq, v in (s.partition("=") for s in inside) if eq and k}


def list_files(path: str) -> tuple[list[str], str]:
    """Data files of a directory or glob, sorted, and the root that partition segments count from."""
    if fs.is_dir(path):
        found = [x for x in fs.walk(path) if not re.search(r"(^|/)[._]", os.path.relpath(fs.plain(x), fs.plain(path)))]
        root = path
    else:
        found = [x for g in fs.glob(path) for x in ([g] if fs.is_file(g) else list_files(g)[0]) if os.path.basename(x)[0] not in "._"]
        root = re.split(r"[*?\[]", path)[0].rpartition("/")[0] or "."
    files = sorted(f for f in found if formats.extension(f))
    if not files:
        raise DiffError(f"{path}: no data files")
    return files, root


def _read(spark: SparkSession, files: list[str], ext: str, infer_rows: int, delimiter: str, text_columns: frozenset, tag: bool = False, found=None) -> tuple[DataFrame, list, list[str]]:
    """A table of files of one format, the raw text behind it, and warnings. tag: with each row's file; found: kinds and warnings that are known."""
    if ext == ".parquet":
        return formats.read_parquet(spark, files, tag), [], []
    if ext in formats.JSON:
        raw, kinds, warnings = formats.read_json(spark, files, infer_rows, tag, found)
        empty_is_text = False
    else:
        raw, warnings, empty_is_text = formats.read_text(spark, files, formats.delimiter_of(delimiter, formats.TEXT[ext]), tag), [], True
        names = [c for c in raw.columns if c != formats.PATH]
        kinds = formats.infer_by_file(raw, names, infer_rows) if tag else formats.infer(raw, names, infer_rows)
    kinds = {n: (("string", null) if n in text_columns else (kind, null)) for n, (kind, null) in kinds.items()}
    return formats.typed_columns(raw, kinds, empty_is_text), [(raw, kinds)], warnings


def union_by_name(parts: list[DataFrame]) -> DataFrame:
    """Stack tables: missing columns are null, int64 and float64 meet as float64, text and bytes as text; other conflicts are refused."""
    if len(parts) == 1:
        return parts[0]
    kinds: dict[str, Kind] = {}
    for p in parts:
        for f in p.schema.fields:
            k = kind_of(f.dataType)
            if k is None:
                continue
            was = kinds.get(f.name, k)
            if was != k:
                if domain_of(was, k) is None:
                    raise DiffError(f"column {f.name!r} is {was.value} in one file and {k.value} in another")
                k = Kind.FLOAT if Kind.FLOAT in (was, k) else Kind.STRING
            kinds[f.name] = k
    sql = {Kind.BOOL: "boolean", Kind.INT: "long", Kind.FLOAT: "double", Kind.STRING: "string", Kind.BYTES: "binary", Kind.TIMESTAMP: "timestamp", Kind.DATE: "date"}
    cast = [p.select(*(quoted(f.name).cast(sql[kinds[f.name]]).alias(f.name) for f in p.schema.fields if f.name in kinds)) for p in parts]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def with_partitions(df: DataFrame, names: list[str]) -> DataFrame:
    """Partition values, verbatim, as text columns after the data's; taken from each row's file."""
    if clash := [n for n in names if n in df.columns]:
        raise DiffError(f"partition column {clash[0]!r} is also a column of the data")
    values = {n: F.url_decode(F.replace(F.regexp_extract(formats.PATH, f"/{re.escape(n)}=([^/]*)/", 1), F.lit("+"), F.lit("%2B"))) for n in names}
    return df.withColumns({n: F.when(F.col(formats.PATH).contains(f"/{n}="), v) for n, v in values.items()}).drop(formats.PATH)


def open_dataset(spark: SparkSession, path: str, infer_rows: int = 1000, delimiter: str = "", text_columns: frozenset = frozenset()) -> Dataset:
    formats.delimiter_of(delimiter, ",")
    again = lambda names: open_dataset(spark, path, infer_rows, delimiter, text_columns | names)
    path = remote.localize(spark, path)
    base, version = lake.split_version(path)
    if lake.is_table(base):
        files = lake.files_of(base, version)
        df, keys = lake.read(spark, base, files)
        subset = lambda some: lake.read(spark, base, [f for f in files if f.path in some])[0]
        return Dataset(df, files=[(f.path, f.partition) for f in files], subset=subset, constant=frozenset(keys))
    if version is not None:
        raise DiffError(f"{base} is not a table with versions")
    path = fs.local(path)
    if fs.is_file(path):
        ext = formats.extension(path)
        if not ext:
            raise DiffError(f"{path}: unsupported extension")
        try:
            df, raw, warnings = _read(spark, [path], ext, infer_rows, delimiter, text_columns)
        except DiffError:
            raise
        except Exception as e:
            raise DiffError(f"{path}: {str(e).splitlines()[0][:200]}") from None
        return Dataset(df, warnings, raw, again)
    if not fs.is_dir(path) and not re.search(r"[*?\[]", path):
        raise DiffError(f"{path}: no such file or directory")
    files, root = list_files(path)
    values = [(f, hive_values(f, root)) for f in files]
    groups: dict[str, list[str]] = {}
    for f in files:
        groups.setdefault(formats.extension(f), []).append(f)
    parts, raws, warnings = [], [], []
    for ext, some in groups.items():
        batches = [(g[0], g[1:]) for g in formats.json_groups(spark, some, infer_rows)] if ext in formats.JSON else [(b, None) for b in _same_schema(some, ext)]
        for batch, found in batches:
            df, raw, warn = _read(spark, batch, ext, infer_rows, delimiter, text_columns, True, found)
            parts.append(df)
            raws += raw
            warnings += [f"{batch[0]}: {w}" for w in warn]
    df = with_partitions(union_by_name(parts), sorted({k for _, v in values for k in v}))
    return Dataset(df, warnings, raws, again, values, constant=frozenset(k for _, v in values for k in v))


def _same_schema(files: list[str], ext: str) -> list[list[str]]:
    """Files that can be read together: Parquet by footer schema, text by header. Footers and headers are read side by side."""

    def key(f: str) -> str:
        if ext == ".parquet":
            return formats.schema_text(f)
        if ext in formats.TEXT:
            line, ends, _ = formats.unpacked(f, fs.read(f, 0, HEADER_BYTES), HEADER_BYTES).partition(b"\n")
            if ends and line.count(b'"') % 2 == 0 or not f.endswith(formats.PACKED):
                return line.decode("utf-8", "replace")
        return f

    groups: dict = {}
    with ThreadPoolExecutor(32) as pool:
        for f, k in zip(files, pool.map(key, files), strict=True):
            groups.setdefault(k, []).append(f)
    return list(groups.values())


def open_pair(spark: SparkSession, left: str, right: str, infer_rows: int = 1000, delimiter: str = "") -> tuple[Dataset, Dataset, int]:
    """Two versions of one lake table without the files that both share; the rows left out are returned to be counted.

    Only files with known, equal row counts and the same deletion vector are left out, and no delete files may apply."""
    (a, va), (b, vb) = lake.split_version(left), lake.split_version(right)
    if a != b or not lake.is_table(a):
        return open_dataset(spark, left, infer_rows, delimiter), open_dataset(spark, right, infer_rows, delimiter), 0
    ours, theirs = lake.files_of(a, va), lake.files_of(a, vb)
    known = {f.path: f for f in theirs}
    shared = [f for f in ours if f.path in known and f.rows is not None and f.state() == known[f.path].state() and not f.equality and not f.positions]
    if shared and (len(shared) == len(ours) or len(shared) == len(theirs)):
        shared.remove(min(shared, key=lambda f: (f.rows, f.path)))  # neither side may be empty
    gone = {f.path for f in shared}
    one, two = (lake.read(spark, a, [f for f in some if f.path not in gone])[0] for some in (ours, theirs))
    return Dataset(one), Dataset(two), sum(f.live_rows() for f in shared)
