"""Substring dedup by recompression: words covered by a window of 35 words that starts anywhere else as well.

Recompression. The words of a text are symbols, named by hash. A round first names runs of one symbol, then names
neighbouring pairs (a, b) with a from one half of the alphabet and b from the other, the halves being drawn by a bit
of the name. Names are hashes of what they stand for, so all tasks name equal runs and pairs alike without an
exchange. With each boundary between symbols goes the number of words to its left and right that it depends on:
wherever the same words stand, the same boundary does. A symbol together with these words is an *anchor*, and equal
windows hold equal anchors at equal offsets inside. Windows that hold no anchor (inside long runs) are their own.

Search. 1. The anchors of all texts meet by hash in Spark; those that stand at two places are shared. 2. A window can
be repeated only if all anchors inside are shared; such windows meet by two hashes of 64 bits, each a
polynomial of its own over word hashes of its own, which settles the matter. 3. Covered words are removed. Texts are
shuffled once: both joins use the same exchange.

Texts are handled in numbered blocks. What a block sends is packed arrays by hash bucket, each anchor or window at
most once a block (with a mark if it is repeated there already), so the most common window of a corpus sends one
entry for each block. Buckets grow in number with the input's splits.

Defined results: a null or empty text has no words, removes none and keeps the digest of the empty string; rows
that are equal in doc_id and text are documents of their own, so from 35 words on all their words go; rows that
share only doc_id are kept apart; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.llm.common import mix64, pack, partitions_of, slices, small_batches, unpack, utf8
from rowlens.llm.postings import blocks, numbered

WINDOW, ROUNDS, LONGEST = 35, 2, 8
#: One anchor in so many is sent.
SPARSE = 4
#: Text bytes of a block.
BLOCK = 8 << 20
_FAR = 1 << 20
_B1, _B2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of all words (as rows), and where each text begins (one more at the end)."""
    words, at, n = numbered(texts)
    h = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words.to_pylist())), ">u8").astype(np.uint64).reshape(-1, 2)
    return h.T[:, at], np.concatenate([[0], np.cumsum(n)])


def prefix_hash(words: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Sums of words times powers of an odd base modulo 2^64, and the powers' inverses, so that a stretch [a, b) has
    the hash (sum[b] - sum[a]) * inverse[a]."""
    n = len(words)
    inverse = np.uint64(pow(int(base), -1, 1 << 64))

    def powers(x: np.uint64) -> np.ndarray:
        out = np.full(n + 1, x, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers(base)[:n], out=sums[1:])
    return sums, powers(inverse)


def recompress(words: np.ndarray, starts: np.ndarray, rounds: int = ROUNDS, longest: int = LONGEST) -> tuple:
    """Boundaries of the last round's symbols, and for each symbol the words from lo up to hi that it depends on."""
    n = len(words)
    name, at = mix64(words), np.arange(n + 1, dtype=np.int32)
    hard = np.zeros(n + 1, bool)
    hard[starts] = True
    lo, hi = at, at  # what a boundary's being there depends on
    inlo, inhi = at[:-1], at[1:]  # what a symbol's being whole depends on, besides its two boundaries

    def merge(stays: np.ndarray, names: np.ndarray):
        """A boundary that stays depends on the symbols next to it; a new symbol, on what it is made of."""
        nonlocal name, at, hard, lo, hi, inlo, inhi
        kept = np.flatnonzero(stays)
        first, inner, last = kept[:-1], kept[1:-1], len(at) - 1
        near = lambda f, x, y: f.reduce([x[inner - 1], x[inner], x[inner + 1], y[inner - 1], y[inner]])
        within = lambda f, x, y: f.reduce([f.reduceat(x[:last], first), f.reduceat(y, first), x[kept[1:]]])
        new = near(np.minimum, lo, inlo), near(np.maximum, hi, inhi)
        inlo, inhi = within(np.minimum, lo, inlo), within(np.maximum, hi, inhi)
        at, hard, name = at[kept], hard[kept], names
        lo, hi = (np.concatenate([[x], y, [x]]).astype(np.int32) for x, y in ((-_FAR, new[0]), (n + _FAR, new[1])))
        lo, hi = np.where(hard, np.int32(-_FAR), lo), np.where(hard, np.int32(n + _FAR), hi)  # a text's ends stay whatever stands there

    for r in range(rounds):
        if len(name) < 2:
            break
        stays = np.ones(len(at), bool)  # runs
        stays[1:-1] = (name[1:] != name[:-1]) | hard[1:-1]
        first = np.flatnonzero(stays[:-1])
        count = np.diff(np.concatenate([first, [len(name)]]))
        merge(stays, np.where(count > 1, mix64(name[first] + count.astype(np.uint64) * _B2), name[first]))
        if len(name) < 2:
            break
        half = (mix64(name + np.uint64(r + 1)) >> np.uint64(63)).astype(bool)  # pairs
        size = np.diff(at)
        stays = np.ones(len(at), bool)
        stays[1:-1] = half[:-1] | ~half[1:] | hard[1:-1] | (size[1:] + size[:-1] > longest)
        first = np.flatnonzero(stays[:-1])
        single = np.diff(np.concatenate([first, [len(name)]])) == 1
        second = name[np.minimum(first + 1, len(name) - 1)]
        merge(stays, np.where(single, name[first], mix64(name[first] * _B1 + second)))
    return at, np.minimum.reduce([lo[:-1], lo[1:], inlo]), np.maximum.reduce([hi[:-1], hi[1:], inhi])


def anchors(words: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names, first words and ends of the anchors that fit a window, and of the windows without any."""
    n, none = len(words), np.empty(0, np.int64)
    if n < window:
        return np.empty(0, np.uint64), none, none
    _, lo, hi = recompress(words, starts)
    fits = hi - lo <= window
    lo, hi = lo[fits], hi[fits]
    sums, inverse = prefix_hash(words, _B1)
    names = mix64((sums[hi] - sums[lo]) * inverse[lo] + (hi - lo).astype(np.uint64) * _B2)
    some = names % np.uint64(SPARSE) == 0  # equal anchors are kept alike
    names, lo, hi = names[some], lo[some], hi[some]
    starting = windows(starts, window)
    held = np.zeros(n + 1, np.int64)  # anchors inside the window that starts here
    np.add.at(held, np.maximum(hi - window, 0), 1)
    np.add.at(held, lo + 1, -1)
    bare = starting[np.cumsum(held)[starting] == 0]
    own = mix64((sums[bare + window] - sums[bare]) * inverse[bare] + np.array([window], np.uint64) * _B2)
    return np.concatenate([names, own]), np.concatenate([lo, bare]), np.concatenate([hi, bare + window])


def windows(starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The words at which a window of one text starts."""
    ok = np.zeros(int(starts[-1]) + 1, np.int64)
    first, last = starts[:-1], starts[1:] - window + 1
    some = last > first
    np.add.at(ok, first[some], 1)
    np.add.at(ok, last[some], -1)
    return np.flatnonzero(np.cumsum(ok) > 0)


SENT = "bucket long, block long, h1 binary, h2 binary, marks binary, spots binary, known binary, ids binary, hashes binary, starts binary"
_NAMES = [x.split()[0] for x in SENT.split(", ")]
_KINDS = [pa.int64(), pa.int64(), *[pa.binary()] * 8]


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in zip(_NAMES, _KINDS, strict=True)], _NAMES)


def _send(block: int, buckets: int, h1: np.ndarray, h2: np.ndarray | None, spots: np.ndarray, ids: list, hashes: list, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What a block sends: each hash once, with a mark if it stands at two spots here, and what it knows by itself."""
    order = np.lexsort((h2, h1)) if h2 is not None else np.argsort(h1, kind="stable")
    h1, spots = h1[order], spots[order]
    h2 = h2[order] if h2 is not None else None
    new = np.ones(len(h1), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1] if h2 is not None else False)
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(h1)]]))
    twice = np.repeat(count > 1, count)
    head = {"bucket": block % buckets, "block": block, "known": pack(np.sort(spots[twice]).astype(np.uint32)), "ids": pack(np.array(ids, np.int64)), "hashes": pack(np.array(hashes, np.int64)), "starts": pack(starts.astype(np.uint32))}
    yield _rows([head])
    h1, spots, marks = h1[first], spots[first], (count > 1).astype(np.uint8)
    h2 = h2[first] if h2 is not None else None
    to = (h1 % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    edges = np.searchsorted(to[order], np.arange(buckets + 1))
    rows = []
    for k in np.flatnonzero(np.diff(edges)):
        o = order[edges[k] : edges[k + 1]]
        o = o[np.argsort(spots[o])]
        rows.append({"bucket": int(k), "block": block, "h1": h1[o].tobytes(), "h2": h2[o].tobytes() if h2 is not None else None, "marks": pack(marks[o]), "spots": pack(spots[o].astype(np.uint32))})
        if len(rows) == 256:
            yield _rows(rows)
            rows = []
    if rows:
        yield _rows(rows)


def _meet(table: pa.Table) -> pa.Table:
    """In one bucket: spots whose hash another block sent as well; heads pass."""
    heads, h1, h2, marks, spots, owner, blocks_ = [], [], [], [], [], [], []
    for r in table.to_pylist():
        if r["starts"] is not None:
            heads.append(r)
            continue
        a = np.frombuffer(r["h1"], np.uint64)
        h1.append(a)
        h2.append(np.frombuffer(r["h2"], np.uint64) if r["h2"] is not None else np.zeros(len(a), np.uint64))
        marks.append(unpack(r["marks"], np.uint8))
        spots.append(unpack(r["spots"], np.uint32))
        owner.append(np.full(len(a), len(blocks_), np.int64))
        blocks_.append(r["block"])
    out = heads
    if h1:
        h1, h2, marks, spots, owner = (np.concatenate(x) for x in (h1, h2, marks, spots, owner))
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
        twice = np.zeros(len(a), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        tell = twice & (marks == 0)
        who, what = owner[tell], spots[tell]
        edges = np.searchsorted(who, np.arange(len(blocks_) + 1))
        out += [{"bucket": 0, "block": blocks_[i], "known": pack(np.sort(what[edges[i] : edges[i + 1]]))} for i in np.flatnonzero(np.diff(edges))]
    return pa.Table.from_batches([_rows(out)]) if out else pa.Table.from_batches([_rows([])])


def _gathered(table: pa.Table) -> pa.Table:
    """Of one block: the known spots of each text that has any, counted from the text's first word."""
    head, known = None, []
    for r in table.to_pylist():
        head = r if r["starts"] is not None else head
        known.append(unpack(r["known"], np.uint32))
    starts = unpack(head["starts"], np.uint32).astype(np.int64)
    ids, hashes = unpack(head["ids"], np.int64), unpack(head["hashes"], np.int64)
    spots = np.unique(np.concatenate(known)).astype(np.int64)
    edges = np.searchsorted(spots, starts)
    some = np.flatnonzero(np.diff(edges))
    cols = [pa.array(ids[some]), pa.array(hashes[some]), pa.array([pack((spots[edges[i] : edges[i + 1]] - starts[i]).astype(np.uint32)) for i in some], pa.binary())]
    return pa.Table.from_arrays(cols, ["k1", "k2", "spots"])


def _column(held: list, name: str) -> list:
    return [v for b in held for v in b.column(b.schema.get_field_index(name)).to_pylist()]


def _sent_anchors(buckets: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held, texts in blocks(batches, "text", BLOCK):
            (words, _), starts = word_hashes(texts)
            names, lo, _ = anchors(words, starts, window)
            yield from _send(block, buckets, names, None, lo, _column(held, "k1"), _column(held, "k2"), starts)

    return run


def _sent_windows(buckets: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held, texts in blocks(batches, "text", BLOCK):
            both, starts = word_hashes(texts)
            names, lo, hi = anchors(both[0], starts, window)
            told = [unpack(s, np.uint32).astype(np.int64) + a for s, a in zip(_column(held, "spots"), starts, strict=False)]
            shared = np.zeros(both.shape[1] + 1, bool)
            shared[np.concatenate(told)] = True
            alone = ~shared[lo]
            out = np.zeros(both.shape[1] + 2, np.int64)  # windows around an anchor that stands nowhere else
            np.add.at(out, np.maximum(hi[alone] - window, 0), 1)
            np.add.at(out, lo[alone] + 1, -1)
            at = windows(starts, window)
            at = at[np.cumsum(out)[at] == 0]
            h = []
            for words, base in zip(both, (_B1, _B2), strict=True):
                sums, inverse = prefix_hash(words, base)
                h.append(mix64((sums[at + window] - sums[at]) * inverse[at]))
            yield from _send(block, buckets, *h, at, _column(held, "k1"), _column(held, "k2"), starts)

    return run


def _removed(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            rows = []
            for t, spots in zip(utf8(b, "text"), b.column(b.schema.get_field_index("spots")).to_pylist(), strict=True):
                words = t.split()
                n = len(words)
                if spots:
                    cover = np.zeros(n + 1, np.int64)
                    at = unpack(spots, np.uint32).astype(np.int64)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + window, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(cover[:n]) == 0)]
                rows.append((n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("doc_id")), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return run


def repeated_windows(docs: DataFrame, id_col="doc_id", text_col="text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """The texts with keys (k1, k2) of their rows, and for each key whose text has any the starts of its repeated windows."""
    small_batches(docs.sparkSession)
    buckets = 1 << (4 * partitions_of(docs) - 1).bit_length()
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("k1"), F.xxhash64(text_col).alias("k2"), F.col(text_col).alias("text"))

    def met(sent: DataFrame) -> DataFrame:
        answered = sent.groupBy("bucket").applyInArrow(_meet, SENT)
        spots = answered.select("block", "known", "ids", "hashes", "starts").groupBy("block").applyInArrow(_gathered, "k1 long, k2 long, spots binary")
        return spots.groupBy("k1", "k2").agg(F.max("spots").alias("spots"))

    shared = met(texts.select("k1", "k2", "text").mapInArrow(_sent_anchors(buckets, window), SENT))
    return texts, met(texts.join(shared, ["k1", "k2"]).mapInArrow(_sent_windows(buckets, window), SENT))


def remove_repeats(docs: DataFrame, id_col="doc_id", text_col="text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row."""
    texts, repeated = repeated_windows(docs, id_col, text_col, window)
    return texts.join(repeated, ["k1", "k2"], "left").mapInArrow(_removed(window), "doc_id long, n_words long, n_removed long, kept_sha256 string")
