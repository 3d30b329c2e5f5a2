"""What the training-data operators share: shared-folder tables, Arrow text access, packed integer columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which is what ``bytes.split()`` yields,
so texts are handled as UTF-8 bytes and never decoded where code points do not matter.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of an Arrow batch of whole texts (one row at least); bounds what a Python worker holds besides a block.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a local master without that
    setting (tests) gets a temporary folder of its own."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="rowlens-")
        atexit.register(shutil.rmtree, _LOCAL[app], True)
    return "file://" + _LOCAL[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_OPEN: list[scratch] = []


class scratch:
    """Tables that :func:`materialize` writes inside are deleted at the end, except those named by :meth:`keep`."""

    def __init__(self):
        self.made: list[tuple[SparkSession, str]] = []
        self.kept: set[str] = set()

    def keep(self, *tables: DataFrame) -> None:
        self.kept |= {t._written for t in tables}

    def __enter__(self) -> scratch:
        _OPEN.append(self)
        return self

    def __exit__(self, *_) -> None:
        _OPEN.remove(self)
        for spark, path in self.made:
            if path not in self.kept:
                _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and lost executors lose nothing."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    if _OPEN:
        _OPEN[-1].made.append((df.sparkSession, path))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def row_keyed(df: DataFrame, name: str, label: str) -> DataFrame:
    """``df`` with a column that tells its rows apart, the same in every job however its scans are split: file and position
    of a row where ``df`` is a scan of Parquet files (with columns or rows left out), else numbers written with a copy."""
    if _is_scan(df):
        key = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
        return df.select("*", key.alias(name))
    key = F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))
    return materialize(df.select("*", key.alias(name)), label)


ROW_KIND = "struct<file: long, at: long>"


def _is_scan(df: DataFrame) -> bool:
    if "_metadata" in (c.lower() for c in df.columns):
        return False
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation" and plan.toString().strip().endswith("] parquet")


def remove(df: DataFrame) -> None:
    """Delete the files of a table from :func:`materialize` that no later plan reads."""
    _delete(df.sparkSession, df._written)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Whole texts go to Python in batches of at most ``rows`` rows and about ``BATCH_BYTES``."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions_of(df: DataFrame) -> int:
    """Input splits of a plan; grows with the input and so sizes hash buckets."""
    return max(1, df._jdf.queryExecution().toRdd().getNumPartitions())


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A string column as bytes; null becomes empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def values(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds at most about ``most`` bytes of text or one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(batch.schema.get_field_index(text))).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        if sizes.sum() <= most:
            if len(sizes):
                yield batch
            continue
        part = np.cumsum(sizes) // most
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
        for a, b in zip(edges, edges[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def free(df: DataFrame, name: str) -> str:
    """A column name that the table does not have (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pack(a: np.ndarray) -> bytes:
    """Little-endian values with their bytes transposed, so that the shuffle's codec finds the zero bytes."""
    a = np.ascontiguousarray(a)
    return a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if len(a) else b""


def unpack(b: bytes, dtype) -> np.ndarray:
    d = np.dtype(dtype)
    return np.frombuffer(np.frombuffer(b, np.uint8).reshape(d.itemsize, -1).T.tobytes(), d) if b else np.empty(0, d)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x
