"""Frequencies of keys in documents, packed by block of documents and bucket of keys.

What token counts and LM scoring share: each wants, for every document, a sum over its keys of frequency times a value that
only all documents together give. The commonest keys (``HEAD``) are broadcast with
what is known of them and summed where the text is read, so no key that many documents hold is sent. Of the others, a block
sends one row to each bucket: the bucket's keys in the block, and for each key its documents and frequencies as arrays. Rows of a
bucket meet in one exchange; sums go back to their block in a second one. Which keys are in the head changes no sum, so
token counts find them in a bounded sample (:func:`commonest`); where a model is made of them, they come from exact counts
over all texts (:func:`commonest_of_all`).

There are as many buckets as input splits, so what a task holds stays the same while the input grows. Rows number at most blocks
times buckets and never more than postings.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.llm.common import pack, slices, small_batches, unpack

#: Keys of the head; rows of a partition, and of all partitions together (but for one of each), that the sample holds.
HEAD, SAMPLE_ROWS, SAMPLE_ALL = 16_384, 256, 65_536
#: Text bytes and rows after which a block is closed.
BLOCK_BYTES, BLOCK_ROWS = 16 << 20, 60_000
ROWS = "bucket long, block long, keys binary, sizes binary, docs binary, freqs binary, head binary"
_KINDS = [pa.int64(), pa.int64(), *[pa.binary()] * 5]
_NAMES = [x.split()[0] for x in ROWS.split(", ")]
_GAP = b"\xff"  # never in UTF-8


class Ids(dict):
    """Numbers of keys in the order they are met."""

    def __missing__(self, key: bytes) -> int:
        n = self[key] = len(self)
        return n


def numbered(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of string texts, all words as numbers of these, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    offsets = np.asarray(parts.offsets)
    found = parts.flatten().dictionary_encode()
    at, words = found.indices.to_numpy().astype(np.int64), found.dictionary.cast(pa.binary())
    n = np.diff(offsets)
    empty = np.flatnonzero(pc.binary_length(words).to_numpy() == 0)
    if len(empty):  # before, after and instead of words
        there = at != empty[0]
        n = np.diff(np.concatenate([[0], np.cumsum(there)])[offsets - offsets[0]])
        at = at[there]
    return words, at, n.astype(np.int64)


def column(held: list[pa.RecordBatch], name: str) -> pa.Array:
    """A string column of batches; null becomes empty."""
    return pa.chunked_array([b.column(b.schema.get_field_index(name)) for b in held]).cast(pa.string()).combine_chunks().fill_null("")


def counted(key: np.ndarray, doc: np.ndarray, count: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, document) pairs, sorted, and their frequencies. A block has fewer than 65,536 documents."""
    pair = key << 16 | doc
    if count is None:
        pair, count = np.unique(pair, return_counts=True)
    elif len(pair):
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        pair, count = pair[new], np.add.reduceat(count[order], new)
    return pair >> 16, pair & 0xFFFF, count


def blocks(batches: Iterator[pa.RecordBatch], text_col: str, size: int | None = None, rows: int | None = None) -> Iterator[tuple[int, list[pa.RecordBatch], pa.Array]]:
    """Batches and texts gathered into blocks, numbered by partition and order."""
    size, rows = size or BLOCK_BYTES, rows or BLOCK_ROWS
    part, held, n, many = TaskContext.get().partitionId() << 20, [], 0, 0
    for b in slices(batches, text_col):
        more = pc.sum(pc.binary_length(b.column(b.schema.get_field_index(text_col)))).as_py() or 0
        if held and (n + more > size or many + b.num_rows > rows):
            yield part, held, column(held, text_col)
            part, held, n, many = part + 1, [], 0, 0
        held.append(b)
        n, many = n + more, many + b.num_rows
    if held:
        yield part, held, column(held, text_col)


def ids_of(held: list[pa.RecordBatch], id_col: str) -> list:
    return [i for b in held for i in b.column(b.schema.get_field_index(id_col)).cast(pa.int64()).to_pylist()]


def header(block: int, buckets: int, table: dict) -> pa.RecordBatch:
    """What a block knows of its own documents; travels with the postings to come back to the block."""
    t = pa.table(table).combine_chunks()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    row = [[crc32(b"%d" % block) % buckets], [block], [None], [None], [None], [None], [sink.getvalue().to_pybytes()]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, _KINDS, strict=True)], _NAMES)


def opened(head: bytes) -> pa.Table:
    return pa.ipc.open_stream(head).read_all()


def rows_of(block: int, keys: list[bytes], key: np.ndarray, doc: np.ndarray, count: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """A block's postings; key, doc, count: one entry for each, in any order, numbers of keys in ``keys``."""
    if not keys:
        return
    bucket = np.fromiter((crc32(k) for k in keys), np.int64, len(keys)) % buckets
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.arange(len(keys))
    key, doc, count = counted(rank[key], doc, count)
    size = np.bincount(key, minlength=len(keys))
    entry = np.concatenate([[0], np.cumsum(size)])
    held: list[tuple] = []
    starts = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0]))
    for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
        part = slice(entry[a], entry[z])
        held.append((int(bucket[order[a]]), block, _GAP.join([keys[i] for i in order[a:z]]), pack(size[a:z].astype(np.uint32)), pack(doc[part].astype(np.uint16)), pack(count[part].astype(np.uint32)), None))
        if len(held) == 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), _KINDS, strict=True)], _NAMES)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), _KINDS, strict=True)], _NAMES)


def met(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows with all of a bucket in one partition."""
    return rows.repartition(buckets, "bucket")


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple]:
    """(block, header or None, keys, sizes, docs, freqs) of each row."""
    for _, block, keys, sizes, docs, freqs, head in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        if head is not None:
            yield block, head, [], None, None, None
        else:
            yield block, None, keys.split(_GAP), unpack(sizes, np.uint32).astype(np.int64), unpack(docs, np.uint16).astype(np.int64), unpack(freqs, np.uint32).astype(np.int64)


def sums_by_block(spots: np.ndarray, values: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """Sums of values by block << 16 | document: (block, documents, sums of each) for each block."""
    at, where = np.unique(spots, return_inverse=True)
    sums = [np.bincount(where.reshape(-1), weights=v, minlength=len(at)) for v in values]
    block, first = np.unique(at >> 16, return_index=True)
    for b, x, y in zip(block.tolist(), first.tolist(), [*first[1:].tolist(), len(at)], strict=True):
        yield b, (at[x:y] & 0xFFFF).astype(np.uint16), [s[x:y] for s in sums]


def commonest(docs: DataFrame, text_col: str, splits: int, keys_of, n: int = HEAD) -> list[tuple[bytes, int]]:
    """The commonest keys of a sample, the first rows of each partition, with their frequencies there; commonest first.

    keys_of: made once in a task, turns texts into a Counter of keys. Each task sends its ``n`` commonest at most."""
    small_batches(docs.sparkSession)
    rows = max(1, min(SAMPLE_ROWS, SAMPLE_ALL // max(1, splits)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, count, left = keys_of(), Counter(), rows
        for b in slices(batches, text_col):
            count.update(some(column([b.slice(0, left)], text_col)))
            left -= b.num_rows
            if left <= 0:
                break
        top = count.most_common(n)
        if top:
            keys, freqs = zip(*top, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(freqs, pa.int64())], ["key", "n"])

    found = docs.select(text_col).mapInArrow(run, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = found.coalesce(8)  # each partition sends its first n rows to the driver; the sample is small
    return [(bytes(r["key"]), r["n"]) for r in found.orderBy(F.desc("n"), "key").limit(n).collect()]


_COUNTED = "part long, keys binary, counts binary"


def _counted_row(part: int, keys: list[bytes], counts) -> pa.RecordBatch:
    row = [part], [_GAP.join(keys)], [pack(np.asarray(counts, np.int64))]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i else pa.int64()) for i, c in enumerate(row)], [x.split()[0] for x in _COUNTED.split(", ")])


def _summed_counts(rows) -> dict[bytes, int]:
    total: dict[bytes, int] = {}
    for keys, counts in rows:
        for k, c in zip(keys.split(_GAP), unpack(counts, np.int64).tolist(), strict=True):
            total[k] = total.get(k, 0) + c
    return total


def _first(total: dict[bytes, int], n: int) -> list[tuple[bytes, int]]:
    some = total.items()
    if len(total) > n:  # keys under the n-th count cannot be among the first
        counts = np.fromiter(total.values(), np.int64, len(total))
        least = np.partition(counts, len(counts) - n)[len(counts) - n]
        some = [x for x in some if x[1] >= least]
    return sorted(some, key=lambda x: (-x[1], x[0]))[:n]


def commonest_of_all(docs: DataFrame, text_col: str, buckets: int, keys_of, n: int = HEAD) -> list[tuple[bytes, int]]:
    """The commonest keys of all texts with their frequencies; commonest first, then by key.

    keys_of: turns the texts of a block into distinct keys and their frequencies. Every key is summed whole in the task of
    its bucket, which sends its ``n`` first on; those of tasks are merged in groups, as many as the root of ``buckets``,
    and on the driver."""
    if not n:
        return []
    small_batches(docs.sparkSession)
    fan = int(buckets**0.5) + 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, texts in blocks(batches, text_col):
            keys, freqs = keys_of(texts)
            bucket = np.fromiter((crc32(k) for k in keys), np.int64, len(keys)) % buckets
            order = np.argsort(bucket, kind="stable")
            starts = np.flatnonzero(np.diff(bucket[order], prepend=-1)).tolist()
            for a, z in zip(starts, [*starts[1:], len(keys)], strict=False):
                yield _counted_row(int(bucket[order[a]]), [keys[i] for i in order[a:z]], freqs[order[a:z]])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = _first(_summed_counts(r for b in batches for r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)), n)
        if top:
            yield _counted_row(TaskContext.get().partitionId() % fan, *map(list, zip(*top, strict=True)))

    found = docs.select(text_col).mapInArrow(count, _COUNTED)
    for groups in (buckets, fan):
        found = found.repartition(groups, "part").mapInArrow(merge, _COUNTED)
    return _first(_summed_counts((bytes(r["keys"]), bytes(r["counts"])) for r in found.collect()), n)
