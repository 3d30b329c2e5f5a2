"""Lake tables: the live files of a Delta version or an Iceberg snapshot, with their deletes and partition values.

Metadata is read on the driver; data, position deletes and equality deletes are Spark scans joined by anti-joins."""

from __future__ import annotations

import json
import os
import re
import struct
import urllib.parse
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlens.errors import DiffError
from rowlens.functions.canon import quoted
from rowlens.sources import avro, formats, fs

_Z85 = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.-:+=^!/*?&<>()[]{}@%$#"  # fixed alphabet of the encoding
_DV_MAGIC = 1681511377  # fixed by the format


@dataclass
class TableFile:
    path: str
    partition: dict[str, str] = field(default_factory=dict)
    rows: int | None = None
    sequence: int = 0
    vector: dict | None = None  # Delta deletion vector
    positions: tuple[str, ...] = ()  # Iceberg position delete files that may apply
    equality: tuple[tuple[str, int, tuple[str, ...]], ...] = ()  # (file, sequence, columns)
    location: str = ""  # the Iceberg table's recorded root

    def state(self) -> tuple:
        return self.rows, json.dumps(self.vector, sort_keys=True), self.positions, self.equality

    def live_rows(self) -> int:
        """Rows without those that a deletion vector takes; only of files that no position or equality deletes apply to."""
        return self.rows - self.vector["cardinality"] if self.vector else self.rows


def split_version(path: str) -> tuple[str, str | None]:
    """``table#version``; only of an existing directory."""
    base, mark, version = path.rpartition("#")
    return (base, version) if mark and not path.startswith(("http://", "https://")) and fs.is_dir(base) else (path, None)


def is_table(path: str) -> bool:
    if path.startswith(("http://", "https://")):
        return False
    return fs.is_dir(os.path.join(path, "_delta_log")) or any(x.endswith(".metadata.json") for x in fs.names(os.path.join(path, "metadata")))


def files_of(path: str, version: str | None) -> list[TableFile]:
    root = fs.local(path).rstrip("/")
    return delta_files(root, version) if fs.is_dir(os.path.join(root, "_delta_log")) else iceberg_files(root, version)


# ---- Delta


def delta_files(root: str, version: str | None = None) -> list[TableFile]:
    """Replay the newest checkpoint at or below the version, then the commits after it."""
    log = os.path.join(root, "_delta_log")
    listed = fs.names(log)
    commits = {int(m[1]): x for x in listed if (m := re.fullmatch(r"(\d{20})\.json", x))}
    points: dict[int, list[str]] = {}
    for x in listed:
        if m := re.fullmatch(r"(\d{20})\.checkpoint(?:\.(\d{10})\.(\d{10}))?\.parquet", x):
            points.setdefault(int(m[1]), []).append(x)
    whole = {v: xs for v, xs in points.items() if not (m := re.search(r"\.(\d{10})\.parquet$", xs[0])) or len(xs) == int(m[1])}
    if not commits and not whole:
        raise DiffError(f"{root}: the log is empty")
    last = max([*commits, *whole])
    if version is not None and not re.fullmatch(r"\d+", version):
        raise DiffError(f"{root}: {version!r} is not a version")
    want = last if version is None else int(version)
    if want > last:
        raise DiffError(f"{root}: no version {want}; the last is {last}")
    live: dict[str, TableFile] = {}
    start = max((v for v in whole if v <= want), default=-1)
    if start >= 0:
        import pyarrow.parquet as pq

        for x in whole[start]:
            try:
                rows = pq.read_table(pa.BufferReader(fs.read(os.path.join(log, x))), columns=["add"]).to_pylist()
            except Exception as e:
                raise DiffError(f"{x}: {str(e)[:120]}") from None
            for r in rows:
                if r["add"] and r["add"].get("path"):
                    _delta_add(root, r["add"], live)
    for v in range(start + 1, want + 1):
        if v not in commits:
            raise DiffError(f"{root}: commit {v} is missing from the log")
        for line in fs.read(os.path.join(log, commits[v])).decode("utf-8", "replace").split("\n"):
            if not line.strip():
                continue
            try:
                action = json.loads(line)
            except ValueError:
                raise DiffError(f"{commits[v]}: a line is not JSON") from None
            if "remove" in action:
                live.pop(urllib.parse.unquote(action["remove"]["path"]), None)
            elif "add" in action:
                _delta_add(root, action["add"], live)
    return [live[k] for k in sorted(live)]


def _delta_add(root: str, add: dict, live: dict[str, TableFile]) -> None:
    name = urllib.parse.unquote(add["path"])
    if not name.endswith(".parquet"):
        raise DiffError(f"{name}: only Parquet data files are read")
    values = add.get("partitionValues") or {}
    values = {k: v or "" for k, v in (values.items() if isinstance(values, dict) else values)}
    stats = json.loads(add["stats"]) if add.get("stats") else {}
    vector = add.get("deletionVector")
    vector = {k: vector.get(k) for k in ("storageType", "pathOrInlineDv", "offset", "sizeInBytes", "cardinality")} if vector and vector.get("storageType") else None
    path = name if os.path.isabs(name) or "://" in name else os.path.join(root, name)
    rows = stats.get("numRecords")
    live[name] = TableFile(path, values, formats.row_count(path) if rows is None else rows, vector=vector)


def z85(text: str) -> bytes:
    if len(text) % 5:
        raise DiffError("deletion vector: malformed text encoding")
    out = b""
    for i in range(0, len(text), 5):
        n = 0
        for c in text[i : i + 5]:
            if (d := _Z85.find(c)) < 0:
                raise DiffError("deletion vector: malformed text encoding")
            n = n * 85 + d
        if n >> 32:
            raise DiffError("deletion vector: malformed text encoding")
        out += struct.pack(">I", n)
    return out


def vector_bytes(root: str, v: dict) -> bytes:
    """The checked bytes of a deletion vector: inline, or at an offset of a file beside the data."""
    kind, where = v["storageType"], v["pathOrInlineDv"]
    if kind == "i":
        data = z85(where)[: v["sizeInBytes"]]
        if len(data) != v["sizeInBytes"]:
            raise DiffError("deletion vector: size does not match")
        return data
    if kind == "u":
        h = z85(where[-20:]).hex()
        path = os.path.join(root, where[:-20], f"deletion_vector_{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}.bin")
    elif kind == "p":
        path = urllib.parse.unquote(where).removeprefix("file://")
    else:
        raise DiffError(f"deletion vector: unknown storage {kind!r}")
    try:
        whole = fs.read(path, v["offset"] or 0, v["sizeInBytes"] + 8)
        size = struct.unpack(">i", whole[:4])[0]
        data, crc = whole[4 : 4 + max(0, size)], whole[4 + max(0, size) : 8 + max(0, size)]
    except (OSError, struct.error) as e:
        raise DiffError(f"deletion vector: {e}") from None
    if size != v["sizeInBytes"] or len(data) != size:
        raise DiffError("deletion vector: size does not match")
    if len(crc) != 4 or struct.unpack(">I", crc)[0] != zlib.crc32(data):
        raise DiffError("deletion vector: checksum does not match")
    return data


def positions(data: bytes, cardinality: int | None = None) -> np.ndarray:
    """The row positions of a deletion vector: 32-bit roaring bitmaps under 32-bit high keys."""
    try:
        if struct.unpack_from("<i", data)[0] != _DV_MAGIC:
            raise DiffError("deletion vector: not a bitmap array")
        n, at, out = struct.unpack_from("<q", data, 4)[0], 12, []
        for _ in range(n):
            high = struct.unpack_from("<I", data, at)[0]
            low, at = _roaring(data, at + 4)
            out.append(low + (high << 32))
    except (struct.error, ValueError, IndexError):
        raise DiffError("deletion vector: bitmap is malformed") from None
    every = np.concatenate(out) if out else np.empty(0, np.int64)
    if cardinality is not None and len(every) != cardinality:
        raise DiffError("deletion vector: cardinality does not match")
    return every


def _roaring(data: bytes, at: int) -> tuple[np.ndarray, int]:
    cookie = struct.unpack_from("<I", data, at)[0]
    at += 4
    runs = None
    if cookie & 0xFFFF == 12347:
        n = (cookie >> 16) + 1
        runs = np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, at), bitorder="little")
        at += (n + 7) // 8
    elif cookie == 12346:
        n = struct.unpack_from("<I", data, at)[0]
        at += 4
    else:
        raise ValueError("cookie")
    heads = np.frombuffer(data, "<u2", 2 * n, at).reshape(n, 2).astype(np.int64)
    at += 4 * n
    if runs is None or n >= 4:
        at += 4 * n
    out = []
    for i, (key, less) in enumerate(heads):
        if runs is not None and runs[i]:
            k = struct.unpack_from("<H", data, at)[0]
            pairs = np.frombuffer(data, "<u2", 2 * k, at + 2).reshape(k, 2).astype(np.int64)
            low = np.concatenate([np.arange(a, a + b + 1) for a, b in pairs]) if k else np.empty(0, np.int64)
            at += 2 + 4 * k
        elif less + 1 <= 4096:
            low = np.frombuffer(data, "<u2", less + 1, at).astype(np.int64)
            at += 2 * (less + 1)
        else:
            low = np.flatnonzero(np.unpackbits(np.frombuffer(data, np.uint8, 8192, at), bitorder="little"))
            at += 8192
        out.append(low + (int(key) << 16))
    return np.concatenate(out) if out else np.empty(0, np.int64), at


# ---- Iceberg


def _metadata(root: str) -> dict:
    folder = os.path.join(root, "metadata")
    hint = os.path.join(folder, "version-hint.text")
    names = [x for x in fs.names(folder) if x.endswith(".metadata.json")]
    pick = None
    if fs.is_file(hint):
        v = fs.read(hint).decode().strip()
        pick = next((x for x in (f"v{v}.metadata.json", f"{v}.metadata.json") if x in names), None)
    pick = pick or max(names, key=lambda x: (int(m[1]) if (m := re.match(r"v?(\d+)", x)) else -1, x))
    return json.loads(fs.read(os.path.join(folder, pick)))


def rebase(path: str, location: str, root: str) -> str:
    """A recorded path under the table's actual root."""
    strip = lambda p: re.sub(r"^\w+:/*", "/", p).rstrip("/")
    path, location = strip(path), strip(location)
    if path.startswith(location + "/"):
        return os.path.join(root, path[len(location) + 1 :])
    for part in ("/metadata/", "/data/"):
        if part in path:
            return os.path.join(root, part.strip("/"), path.rpartition(part)[2])
    return path


def iceberg_files(root: str, snapshot: str | None = None) -> list[TableFile]:
    meta = _metadata(root)
    known = {s["snapshot-id"]: s for s in meta.get("snapshots", [])}
    want = meta.get("current-snapshot-id") if snapshot is None else int(snapshot) if re.fullmatch(r"-?\d+", snapshot) else snapshot
    if want in (None, -1):
        return []
    if want not in known:
        raise DiffError(f"{root}: no snapshot {want}; there are {', '.join(map(str, known))}")
    names: dict[int, str] = {}
    for s in meta.get("schemas") or [meta.get("schema", {"fields": []})]:
        names |= {f["id"]: f["name"] for f in s["fields"]}
    here = lambda p: rebase(p, meta.get("location", ""), root)

    def load(path: str) -> Iterator[dict]:
        try:
            return avro.records(fs.read(here(path)))
        except OSError as e:
            raise DiffError(str(e)) from None

    data, pos, eq = [], [], []
    for m in load(known[want]["manifest-list"]):
        for e in load(m["manifest_path"]):
            if e["status"] == 2:
                continue
            d = e["data_file"]
            if str(d.get("file_format", "PARQUET")).upper() != "PARQUET":
                raise DiffError(f"{d['file_path']}: only Parquet data files are read")
            seq = e.get("sequence_number")
            seq = m.get("sequence_number") or 0 if seq is None else seq
            path = here(d["file_path"])
            if (content := d.get("content") or 0) == 0:
                values = {k: "" if v is None else str(v) for k, v in (d.get("partition") or {}).items()}
                data.append(TableFile(path, values, d.get("record_count"), seq, location=meta.get("location", "")))
            elif content == 1:
                pos.append((path, seq))
            else:
                ids = d.get("equality_ids") or []
                if missing := [i for i in ids if i not in names]:
                    raise DiffError(f"equality delete names unknown field {missing[0]}")
                eq.append((path, seq, tuple(names[i] for i in ids)))
    for f in data:
        f.positions = tuple(sorted(p for p, s in pos if s >= f.sequence))
        f.equality = tuple(sorted(x for x in eq if x[1] > f.sequence))
    return sorted(data, key=lambda f: f.path)


# ---- reading


def _relative(c, root: str):
    """The path of a scanned file below the table's root."""
    return F.regexp_replace(F.regexp_replace(F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), "^[a-z0-9]+:/*", "/"), "^" + re.escape(fs.plain(root)) + "/+", "")


def _rebased(c, location: str, root: str):
    """As :func:`rebase`, in Spark: the path below the root that a recorded path stands for."""
    p = F.regexp_replace(c, r"^\w+:/*", "/")
    location = re.sub(r"^\w+:/*", "/", location).rstrip("/")
    out = F.when(F.lit(bool(location)) & p.startswith(location + "/"), F.substring(p, len(location) + 2, 1 << 30))
    for part in ("/metadata/", "/data/"):
        out = out.when(p.contains(part), F.concat(F.lit(part[1:]), F.substring_index(p, part, -1)))
    return out.otherwise(F.regexp_replace(p, "^" + re.escape(fs.plain(root)) + "/+", ""))


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for rel, data, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            at = positions(data, n)
            yield pa.RecordBatch.from_arrays([pa.array([rel] * len(at), pa.string()), pa.array(at, pa.int64())], ["d_file", "d_pos"])


def read(spark: SparkSession, root: str, files: list[TableFile]) -> tuple[DataFrame, list[str]]:
    """The live rows of some files of a table, and the names of those partition columns that only metadata holds."""
    root = os.path.abspath(fs.local(root)) if fs.is_local(root) else root.rstrip("/")
    if not files:
        raise DiffError(f"{root}: no data files")
    rel = lambda p: os.path.relpath(fs.plain(p), fs.plain(root))
    base = formats.read_parquet(spark, [f.path for f in files])
    cols = base.columns
    df = spark.read.option("mergeSchema", True).parquet(*(f.path for f in files))
    cols = [*cols, *(c for c in df.columns if c not in cols)]
    df = df.select("*", _relative(F.col("_metadata.file_path"), root).alias("__file"), F.col("_metadata.row_index").alias("__row"))
    vectors = [(rel(f.path), vector_bytes(root, f.vector), f.vector["cardinality"]) for f in files if f.vector]
    if vectors:
        gone = spark.createDataFrame(vectors, "f string, data binary, n long").mapInArrow(_decoded, "d_file string, d_pos long")
        df = df.join(gone, (F.col("__file") == F.col("d_file")) & (F.col("__row") == F.col("d_pos")), "left_anti")
    where = {p for f in files for p in f.positions}
    if where:
        applies = spark.createDataFrame([(rel(p), rel(f.path)) for f in files for p in f.positions], "d_source string, d_file string")
        deletes = spark.read.parquet(*sorted(where)).select(F.col("file_path"), F.col("pos").alias("d_pos"), _relative(F.col("_metadata.file_path"), root).alias("d_source"))
        deletes = deletes.withColumn("d_file", _rebased(F.col("file_path"), files[0].location, root)).join(applies, ["d_source", "d_file"]).select("d_file", "d_pos")
        df = df.join(deletes, (F.col("__file") == F.col("d_file")) & (F.col("__row") == F.col("d_pos")), "left_anti")
    equality = {e for f in files for e in f.equality}
    if equality:
        seqs = spark.createDataFrame([(rel(f.path), f.sequence) for f in files], "s_file string, s_seq long")
        df = df.join(seqs, F.col("__file") == F.col("s_file")).drop("s_file")
        for path, seq, by in sorted(equality):
            gone = spark.read.parquet(path)
            for c in by:
                if c not in df.columns or c not in gone.columns:
                    raise DiffError(f"equality delete: no column {c!r}")
            gone = gone.select(*(quoted(c).alias(f"e{i}") for i, c in enumerate(by))).distinct()
            on = reduce(lambda a, b: a & b, (quoted(c).eqNullSafe(F.col(f"e{i}")) for i, c in enumerate(by)))
            df = df.join(gone, on & (F.col("s_seq") < seq), "left_anti")
        df = df.drop("s_seq")
    keys = sorted({k for f in files for k in f.partition if k not in cols})
    if keys:
        values = spark.createDataFrame([(rel(f.path), *(f.partition.get(k) for k in keys)) for f in files], "p_file string, " + ", ".join(f"p{i} string" for i in range(len(keys))))
        df = df.join(values, F.col("__file") == F.col("p_file"), "left").withColumnsRenamed({f"p{i}": k for i, k in enumerate(keys)})
    meta = {f.name: f.metadata for f in base.schema.fields}
    return df.select(*(quoted(c).alias(c, metadata=meta.get(c, {})) for c in cols), *(quoted(k) for k in keys)), keys
