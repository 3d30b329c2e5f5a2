"""Comparisons of stored copies: baselines, and tables written in a format and opened again."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowlens import api
from rowlens.operators import classified, snapshot
from rowlens.plans.options import Options
from rowlens.sources import avro
from rowlens.sources.dataset import open_dataset
from rowlens.sources.scratch import new_path


def baseline(spark: SparkSession, left: DataFrame, right: DataFrame, key: str = "o_orderkey") -> DataFrame:
    """Counts of a live table against a baseline of another."""
    path = new_path(spark, "baseline")
    snapshot.write(left, path, Options(), [key])
    rows, _, _ = snapshot.compare_with(right, path, Options())
    return classified.counts(rows)


def round_trip(spark: SparkSession, left: DataFrame, right: DataFrame, how: str, key: str = "o_orderkey", partition: str = "o_orderpriority") -> DataFrame:
    """Counts after both sides went through files: csv, gzipped csv, ndjson, or parquet in hive partitions."""
    sides = []
    for df in (left, right):
        path = new_path(spark, how)
        if how in ("csv", "csv_gz"):
            df.write.option("compression", "gzip" if how == "csv_gz" else "none").option("header", True).option("escape", '"').option("emptyValue", '""').csv(path)
        elif how == "ndjson":
            df.write.json(path)
            _suffix(spark, path, ".json", ".ndjson")
        else:
            df.write.partitionBy(partition).parquet(path)
        data = open_dataset(spark, path)
        sides.append(data.retyped(bad).df if (bad := data.contradictions()) else data.df)
    rows, _ = api.classify(*sides, Options(key=[key]))
    return classified.counts(rows)


def _suffix(spark: SparkSession, path: str, old: str, new: str) -> None:
    """Rename the part files of a folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for s in fs.listStatus(folder):
        if (name := s.getPath().getName()).endswith(old):
            fs.rename(s.getPath(), spark._jvm.org.apache.hadoop.fs.Path(folder, name.removesuffix(old) + new))


def delta_versions(spark: SparkSession, shared: DataFrame, left: DataFrame, right: DataFrame, key: str = "o_orderkey") -> DataFrame:
    """Counts between two versions of a Delta table that have files in common: those are not read, only counted."""
    root = new_path(spark, "delta")
    named = {}
    for name, df in (("shared", shared), ("old", left), ("new", right)):
        df.write.parquet(f"{root}/{name}")
        named[name] = [f"{name}/{f.rpartition('/')[2]}" for f in spark.read.parquet(f"{root}/{name}").inputFiles()]
    add = lambda f: {"add": {"path": f, "partitionValues": {}, "size": 0, "modificationTime": 0, "dataChange": True}}
    commits = [[add(f) for f in named["shared"] + named["old"]], [{"remove": {"path": f, "dataChange": True}} for f in named["old"]] + [add(f) for f in named["new"]]]
    _put(spark, f"{root}/_delta_log", {f"{v:020}.json": "".join(json.dumps(a) + "\n" for a in c) for v, c in enumerate(commits)})
    r = api.diff(spark, f"{root}#0", f"{root}#1", Options(key=[key]))
    names = ("left_rows", "right_rows", "added", "removed", "changed", "unchanged", "within_tolerance")
    return spark.createDataFrame([tuple(getattr(r, n) for n in names)], ", ".join(f"{n} long" for n in names))


def _renamed(spark: SparkSession, folder: str, name: str) -> str:
    """The one part file of a folder, under another name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("part-"))
    fs.rename(part, spark._jvm.org.apache.hadoop.fs.Path(folder, name))
    return f"{folder}/{name}"


_ENTRY = {"type": "record", "name": "entry", "fields": [{"name": "status", "type": "int"}, {"name": "sequence_number", "type": "long"}, {"name": "data_file", "type": {"type": "record", "name": "file", "fields": [
    {"name": "content", "type": "int"}, {"name": "file_path", "type": "string"}, {"name": "file_format", "type": "string"}, {"name": "record_count", "type": "long"}]}}]}
_MANIFEST = {"type": "record", "name": "manifest", "fields": [{"name": "manifest_path", "type": "string"}, {"name": "sequence_number", "type": "long"}]}


def merge_on_read(spark: SparkSession, parts: list[DataFrame], gone: str, key: str = "o_orderkey") -> DataFrame:
    """Counts between two snapshots of an Iceberg table: the second deletes rows by position in files whose names are equal
    in all partitions. Its metadata name a place where the table no longer is."""
    root, was = new_path(spark, "iceberg"), "s3://elsewhere/warehouse/t"
    files = []
    for i, df in enumerate(parts):
        df.coalesce(1).write.parquet(f"{root}/data/part={i}")
        path = _renamed(spark, f"{root}/data/part={i}", "data.parquet")
        files.append((f"data/part={i}/data.parquet", spark.read.parquet(path)))
    deletes = None
    for name, df in files:
        some = df.where(gone).select(F.lit(f"{was}/{name}").alias("file_path"), F.col("_metadata.row_index").alias("pos"))
        deletes = some if deletes is None else deletes.union(some)
    deletes.coalesce(1).write.parquet(f"{root}/data/deletes")
    _renamed(spark, f"{root}/data/deletes", "deletes.parquet")
    entry = lambda content, name, rows: {"status": 1, "sequence_number": content + 1, "data_file": {"content": content, "file_path": f"{was}/{name}", "file_format": "PARQUET", "record_count": rows}}
    manifests = {"data": [entry(0, name, df.count()) for name, df in files], "deletes": [entry(1, "data/deletes/deletes.parquet", 0)]}
    listed = lambda *names: avro.written(_MANIFEST, [{"manifest_path": f"{was}/metadata/{n}.avro", "sequence_number": 1 + (n == "deletes")} for n in names])
    meta = {"location": was, "current-snapshot-id": 2, "schemas": [{"schema-id": 0, "fields": []}], "snapshots": [{"snapshot-id": i, "manifest-list": f"{was}/metadata/snap-{i}.avro"} for i in (1, 2)]}
    _put(spark, f"{root}/metadata", {f"{n}.avro": avro.written(_ENTRY, rows) for n, rows in manifests.items()} | {"snap-1.avro": listed("data"), "snap-2.avro": listed("data", "deletes"), "v1.metadata.json": json.dumps(meta)})
    r = api.diff(spark, f"{root}#1", f"{root}#2", Options(key=[key]))
    names = ("left_rows", "right_rows", "added", "removed", "changed", "unchanged", "within_tolerance")
    return spark.createDataFrame([tuple(getattr(r, n) for n in names)], ", ".join(f"{n} long" for n in names))


def _put(spark: SparkSession, folder: str, files: dict[str, str | bytes]) -> None:
    """Small files, through Hadoop's file system."""
    for name, text in files.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(folder, name)
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write(bytearray(text if isinstance(text, bytes) else text.encode()))
        out.close()
