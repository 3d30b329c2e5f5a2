"""Remote addresses: s3 paths become s3a for Spark's connector; http files are fetched to the shared folder."""

from __future__ import annotations

import os
import urllib.error
import urllib.parse
import urllib.request

from pyspark.sql import SparkSession

from rowlens.errors import DiffError
from rowlens.sources import formats
from rowlens.sources.scratch import new_path


def s3a(path: str) -> str:
    return "s3a://" + path.split("://", 1)[1] if path.startswith(("s3://", "s3n://")) else path


def configure_s3(spark: SparkSession, endpoint: str) -> None:
    """A custom endpoint is addressed path-style."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("fs.s3a.endpoint", endpoint)
    conf.set("fs.s3a.path.style.access", "true")


def localize(spark: SparkSession, path: str) -> str:
    """A path that Spark can read. An http address has to name one file; it is fetched in pieces to the shared folder.
    ``AWS_ENDPOINT_URL`` names a custom endpoint of s3 addresses."""
    if not path.startswith(("http://", "https://")):
        if path != s3a(path) and (endpoint := os.environ.get("AWS_ENDPOINT_URL")):
            configure_s3(spark, endpoint)
        return s3a(path)
    name = os.path.basename(urllib.parse.urlparse(path).path)
    if not formats.extension(name):
        raise DiffError(f"{path}: an http address has to name a data file; directories can't be listed")
    target = f"{new_path(spark, 'http')}/{name}"
    place = spark._jvm.org.apache.hadoop.fs.Path(target)
    try:
        with urllib.request.urlopen(path, timeout=60) as got:
            out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
            try:
                while part := got.read(1 << 20):
                    out.write(bytearray(part))
            finally:
                out.close()
    except (urllib.error.URLError, OSError) as e:
        raise DiffError(f"{path}: {e}") from None
    return target
