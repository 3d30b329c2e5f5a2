"""Files by path or address: local ones through the operating system, all others through Hadoop's file systems, as Spark reads them."""

from __future__ import annotations

import glob as globbing
import os
import re
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def is_local(path: str) -> bool:
    return "://" not in path or path.startswith("file://")


def local(path: str) -> str:
    return path.removeprefix("file://")


def plain(path: str) -> str:
    """An absolute path without its scheme (an address keeps its host)."""
    return os.path.abspath(local(path)) if is_local(path) else "/" + path.split("://", 1)[1].strip("/")


def _open(path: str):
    spark = SparkSession.builder.getOrCreate()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark, p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _status(path: str):
    try:
        _, system, p = _open(path)
        return system.getFileStatus(p)
    except Py4JJavaError:  # there is none, or no such file system
        return None


def is_dir(path: str) -> bool:
    if is_local(path):
        return os.path.isdir(local(path))
    s = _status(path)
    return s is not None and s.isDirectory()


def is_file(path: str) -> bool:
    if is_local(path):
        return os.path.isfile(local(path))
    s = _status(path)
    return s is not None and s.isFile()


def qualified(path: str, encoded: bool = False) -> str:
    """A path as its file system names it, for paths to be told apart however they are written; ``encoded``: it is an address that Spark gave."""
    if encoded:
        return re.sub("^file:/+", "/", unquote(path))
    _, system, p = _open(path)
    return qualified(system.makeQualified(p).toUri().toString(), True)


def names(folder: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    if is_local(folder):
        return sorted(os.listdir(local(folder))) if is_dir(folder) else []
    if not is_dir(folder):
        return []
    _, system, p = _open(folder)
    return sorted(s.getPath().getName() for s in system.listStatus(p))


def walk(folder: str) -> list[str]:
    """All files below a folder."""
    if is_local(folder):
        return sorted(os.path.join(d, x) for d, _, some in os.walk(local(folder)) for x in some)
    _, system, p = _open(folder)
    found, out = system.listFiles(p, True), []
    while found.hasNext():
        out.append(found.next().getPath().toString())
    return sorted(out)


def glob(pattern: str) -> list[str]:
    if is_local(pattern):
        return sorted(globbing.glob(local(pattern), recursive=True))
    _, system, p = _open(pattern)
    return sorted(s.getPath().toString() for s in system.globStatus(p) or [])


def read(path: str, offset: int = 0, size: int | None = None) -> bytes:
    """Bytes of a file, for metadata. Raises OSError if it can't be read."""
    if is_local(path):
        with open(local(path), "rb") as f:
            f.seek(offset)
            return f.read(-1 if size is None else size)
    try:
        spark, system, p = _open(path)
        size = max(0, system.getFileStatus(p).getLen() - offset) if size is None else size
        stream = system.open(p)
        try:
            stream.seek(offset)
            return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
        finally:
            stream.close()
    except Py4JJavaError as e:
        raise OSError(f"{path}: {str(e.java_exception)[:200]}") from None


def tail(path: str) -> bytes:
    """The end of a Parquet file, which holds its footer: all that a schema is read from."""
    length = _status(path).getLen()
    end = read(path, max(0, length - 8), 8)
    size = min(length, int.from_bytes(end[:4], "little") + 8)
    return b"PAR1" + read(path, length - size, size)
