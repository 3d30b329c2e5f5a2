"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are brought to lower-case ASCII letters, with each run of ASCII punctuation and white
space as one blank. Items longer than ``SPAN`` characters are looked for in overlapping stretches of that length, so
a long part of an item counts as well. A pattern of m characters may differ by k = floor(rate * m) edits. By the q-gram
lemma a region within k edits shares at least m + 1 - q (1 + k) of the pattern's q-grams, and these lie on at
most k + 1 neighbouring diagonals. Shared q-grams are counted in diagonal bands that overlap by k; regions that reach
the bound are aligned, in a band, and kept if at most k edits remain. (Where m is too short for the bound to reach 1,
k is lowered until it does.) Items shorter than a q-gram have no bound; they are looked for as whole words, without
edits. Whole texts are searched; a text's work is linear in its length and its shared q-grams.

The benchmark is read in blocks of bounded size (one for all usual benchmarks), each of which is broadcast and searched
in a pass over the documents, so no side has to be small. An index takes about 40 bytes for each character of a block.

Defined results: null and empty texts hold nothing; null, empty or wordless items are not looked for; rows that share
a doc_id are reported as one (null ids too), in the pipeline each row is judged by itself; without a finding, a document
has no row; empty tables give an empty result; columns of either table beside id and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.llm.common import slices, small_batches, utf8

Q, RATE, SPAN, STEP = 8, 0.1, 160, 80
#: Characters of a benchmark block, which is broadcast, and of text that is searched at once.
ITEMS_BYTES, CHUNK = 4 << 20, 2 << 20
_TABLE = bytes(ord(" ") if c < 128 and not chr(c).isalnum() else ord(chr(c).lower()) if c < 128 else c for c in range(256))


def normal(text: bytes) -> bytes:
    return b" ".join(text.translate(_TABLE).split())


def budget(m: int, rate: float = RATE, q: int = Q) -> int:
    """Edits that a pattern of m characters may differ by; -1 if the filter can't find it at all."""
    k = int(rate * m)
    while k >= 0 and m + 1 - q * (1 + k) < 1:
        k -= 1
    return k


def align(pattern: bytes, band: bytes, k: int) -> tuple[int, int] | None:
    """Least edits of ``pattern`` against any part of ``band``, and the end of the first such part; None if above k.

    Columns of the alignment are bit vectors of vertical steps (one bit for each pattern character), so a column
    costs a few integer operations; only the columns of the band are computed, and as few as can still matter."""
    m, n = len(pattern), len(band)
    if m - n > k:
        return None
    rows: dict[int, int] = {}
    for i, c in enumerate(pattern):
        rows[c] = rows.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, now = full, 0, m
    best = (m, 0)
    for j, c in enumerate(band):
        same = rows.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        rises, falls = down | ~(across | up) & full, up & across
        if rises & top:
            now += 1
        elif falls & top:
            now -= 1
            if now < best[0]:
                best = now, j + 1
        if now - (n - 1 - j) > k and best[0] > k:
            return None  # each column takes one off at most
        rises, falls = rises << 1 & full, falls << 1 & full
        either = same | down
        up, down = falls | ~(either | rises) & full, rises & either
    return best if best[0] <= k else None


class Items:
    """Patterns of benchmark items with an index of their q-grams."""

    def __init__(self, items: list[tuple[int, bytes]], rate=RATE, q=Q, span=SPAN, step=STEP):
        self.q, self.rate = q, rate
        pats: dict[tuple[int, bytes], None] = {}
        self.short: dict[bytes, dict[tuple[bytes, ...], list[int]]] = {}  # by first word
        for i, text in items:
            t = normal(text)
            if 0 < len(t) < q:
                words = tuple(t.split())
                owners = self.short.setdefault(words[0], {}).setdefault(words, [])
                owners += [i] if i not in owners else []
                continue
            stretches = [t] if len(t) <= span else [t[a : a + span] for a in [*range(0, len(t) - span, step), len(t) - span]]
            for p in stretches:
                if budget(len(p), rate, q) >= 0:
                    pats[i, p] = None
        self.ids = [i for i, _ in pats]
        self.text = [p for _, p in pats]
        self.m = np.array([len(p) for p in self.text], np.int64)
        self.k = np.array([budget(len(p), rate, q) for p in self.text], np.int64)
        self.bound = self.m + 1 - q * (1 + self.k)
        grams, owner, offset = [], [], []
        for j, p in enumerate(self.text):
            g = codes(p)
            grams.append(g), owner.append(np.full(len(g), j, np.int32)), offset.append(np.arange(len(g), dtype=np.int32))
        g, o, f = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((grams, np.uint64), (owner, np.int32), (offset, np.int32)))
        order = np.argsort(g, kind="stable")
        self.owner, self.offset = o[order], f[order]
        self.grams, self.at = np.unique(g[order], return_index=True)
        self.at = np.append(self.at, len(g))
        self.bits = min(24, max(16, len(self.grams).bit_length() + 5))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self._slot(self.grams)] = True

    def _slot(self, g: np.ndarray) -> np.ndarray:
        return (g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def bands(self, text: bytes) -> list[tuple[int, int]]:
        """(pattern, first diagonal) of the bands of ``text`` that reach the bound; a band has 2 k + 1 diagonals."""
        g = codes(text)
        pos = np.flatnonzero(self.seen[self._slot(g)])
        g = g[pos]
        if not len(g):
            return []
        i = np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)
        hit = self.grams[i] == g
        pos, i = pos[hit], i[hit]
        n = self.at[i + 1] - self.at[i]
        if not n.sum():
            return []
        each = np.repeat(self.at[i] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        p = self.owner[each].astype(np.int64)
        d = np.repeat(pos, n) - self.offset[each] + self.m[p]  # not negative
        shift = self.k[p] + 1
        b = d // shift
        wide = len(text) + int(self.m.max()) + 2
        low = (d - b * shift < self.k[p]) & (b > 0)  # also in the band before, which reaches k diagonals into this one
        key, count = np.unique(np.concatenate([p * wide + b, (p * wide + b - 1)[low]]), return_counts=True)
        p, b = key // wide, key % wide
        reach = count >= self.bound[p]
        p, b = p[reach], b[reach]
        return list(zip(p.tolist(), (b * (self.k[p] + 1) - self.m[p]).tolist(), strict=True))

    def whole(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(item, 0, first character, end) of the short items that stand in a normalised text as whole words."""
        words = text.split(b" ")
        if self.short.keys().isdisjoint(words):
            return []
        out, at = [], 0
        for i, w in enumerate(words):
            for short, owners in self.short.get(w, {}).items():
                if tuple(words[i : i + len(short)]) == short:
                    out += [(o, 0, at, at + sum(map(len, short)) + len(short) - 1) for o in owners]
            at += len(w) + 1
        return out

    def verify(self, text: bytes, pattern: int, diagonal: int) -> tuple[int, int, int] | None:
        """(edits, about the first character, end) of a region in the band, if it is within budget."""
        k, m = int(self.k[pattern]), int(self.m[pattern])
        a, b = max(0, diagonal - k), min(len(text), diagonal + m + 3 * k + 1)
        region, p = text[a:b], self.text[pattern]
        at = region.find(p)
        if at >= 0:
            return 0, a + at, a + at + m
        got = _aligned(p, region, k)
        return (got[0], max(0, a + got[1] - m), a + got[1]) if got else None


_aligned = lru_cache(4096)(align)


def codes(text: bytes) -> np.ndarray:
    """The 8-grams of a text as integers."""
    if len(text) < Q:
        return np.empty(0, np.uint64)
    return np.ndarray((len(text) - Q + 1,), "<u8", text, 0, (1,)).astype(np.uint64)


def search(texts: list[bytes], items: Items) -> list[list[tuple]]:
    """For each text (item, edits, first character, end) of its regions, in the normalised text."""
    out: list[list[tuple]] = [[] for _ in texts]
    if not items.text and not items.short:
        return out
    chunk, first, size = [], 0, 0

    def flush():
        if items.short:
            for j, t in enumerate(chunk):
                out[first + j] += items.whole(t)
        if not items.text:
            return
        starts = np.cumsum([0, *(len(t) + Q for t in chunk)])
        line = (b"\0" * Q).join(chunk)
        for p, d in items.bands(line):
            middle = min(max(0, d + int(items.m[p]) // 2), len(line) - 1)
            j = int(np.searchsorted(starts, middle, side="right")) - 1
            for t in {j, max(0, j - 1), min(len(chunk) - 1, j + 1)}:  # a band may touch the next text
                if starts[t] <= d + int(items.m[p]) + 4 * int(items.k[p]) and d <= starts[t + 1] and (got := items.verify(chunk[t], p, d - int(starts[t]))):
                    out[first + t].append((items.ids[p], *got))

    for i, t in enumerate(map(normal, texts)):
        if chunk and size + len(t) > CHUNK:
            flush()
            chunk, first, size = [], i, 0
        chunk.append(t)
        size += len(t)
    flush()
    return [sorted(set(x)) for x in out]


def item_blocks(benchmark: DataFrame, id_col="item_id", text_col="text", size: int = ITEMS_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark in lists of about ``size`` bytes."""
    some = benchmark.select(F.col(id_col).cast("long").alias("i"), F.encode(text_col, "UTF-8").alias("t")).where("t is not null")
    total = some.agg(F.coalesce(F.sum(F.octet_length("t") + 16), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // size))
    for j in range(n):
        part = some if n == 1 else some.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == j)
        yield sorted(((r["i"] if r["i"] is not None else -1, bytes(r["t"])) for r in part.collect()), key=lambda x: x)


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row for each document that holds an item: doc_id, item_ids (array, sorted), n_regions, least_edits."""
    spark = docs.sparkSession
    small_batches(spark)
    schema = "doc_id long, item_ids array<long>, n_regions long, least_edits long"
    found = None
    for block in item_blocks(benchmark):
        items = spark.sparkContext.broadcast(Items(block))

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, text_col):
                got = search(utf8(b, text_col), items.value)
                some = [i for i, x in enumerate(got) if x]
                if some:
                    ids = b.column(b.schema.get_field_index(id_col)).cast(pa.int64()).take(pa.array(some))
                    cols = [[sorted({r[0] for r in got[i]}) for i in some], [len(got[i]) for i in some], [min(r[1] for r in got[i]) for i in some]]
                    yield pa.RecordBatch.from_arrays([ids, pa.array(cols[0], pa.list_(pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["doc_id", "item_ids", "n_regions", "least_edits"])

        part = docs.select(id_col, text_col).mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    merged = found.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.sum("n_regions").alias("n_regions"), F.min("least_edits").alias("least_edits"))
    return merged


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col="text") -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns, without a shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    for block in item_blocks(benchmark):
        items = spark.sparkContext.broadcast(Items(block))

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, text_col):
                yield b.filter(pa.array([not x for x in search(utf8(b, text_col), items.value)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
