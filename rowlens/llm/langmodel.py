"""LM scoring with a hashed maximum-entropy model.

A text is its lower-cased words and one end. The model predicts a token in three factors: its class (32), its member of
the class (32; together a *slot*) and the token among those of its slot,

    P(token | history) = P(class | history) P(member | class, history) P(token | slot).

The first two are softmaxes over sums of hashed features: a bias, the word before, the word before that (skip) and both
(n-gram). Slots come from counts over all training texts: each of the ``OWN`` commonest tokens has one of its own, so the history predicts the
token itself; the rest of the head (see :mod:`rowlens.llm.postings`) shares ``MIDDLE`` slots by rank; all other tokens share
``TAIL`` slots by hash, each dealt into pages. Within a shared slot a token has its smoothed share: of the slot's
training tokens in the middle, of the page's in the tail (and the page of the slot's), with one place on each page for
all unseen tokens. So probabilities sum to 1.

Training. In each round every task takes gradient steps (AdaGrad, mini-batches) over its own texts from the broadcast
weights; rows of weights come back with the number of batches that moved them and are averaged by it, chunk by
chunk, in streams and two steps. Rounds split the training texts, so each is learnt from once; on the way the tokens of the head and of
the pages are counted. There are as many rows of weights of each feature as tokens in the head, up to ``ROWS_MOST`` (what a
task sends back); unigram counts have no bound. Scores depend on how the input is split into tasks, as training does.

Counts. Token counts, the base (an add-0.1 unigram model) and the third factor are exact, over all training texts. The
head's are broadcast and summed where the text is read; other tokens meet their counts in the task of their bucket.

Training texts are those whose crc32 of the doc_id as text is not 0 modulo 10; a null doc_id counts as empty text, so
it is held out. Defined results: a null or empty text is one end; rows that share a doc_id are scored one by one;
without training texts, weights are 0 and counts empty, and all is still defined; an empty table gives an empty
result. The input has to be a deterministic plan, such as a scan.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.llm.common import materialize, mix64, pack, partitions_of, slices, small_batches, unpack
from rowlens.llm.postings import HEAD, ROWS, Ids, blocks, column, commonest_of_all, counted, header, ids_of, met, numbered, opened, rows_of, sums_by_block, unpacked

CLASSES, MEMBERS = 32, 32
#: Slots of each kind; they fill all members of all classes.
OWN, MIDDLE, TAIL = 704, 192, 128
#: Most rows of hashed weights of each feature (row numbers have 16 bits); rounds; tokens of a mini-batch; step size.
ROWS_MOST, ROUNDS, BATCH, STEP = 16_384, 2, 16_384, 0.15
HELD_OUT = 10
#: Longest token that stands as itself.
KEY_BYTES = 40
_END, _START = crc32(b"\x00end"), crc32(b"\x00start")
_CHUNK = 1024  # rows of weights
_COUNTS = -1  # the chunk that holds counts


def token_key(word: bytes) -> bytes:
    """A long token stands as its digest, marked by a byte that UTF-8 never holds."""
    return word if len(word) <= KEY_BYTES else b"\xfe" + hashlib.sha256(word).hexdigest().encode()


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct tokens of texts, lower-cased words and the end (the empty word, last), all tokens as numbers of these,
    and how many each text has."""
    words, at, n = numbered(texts, lower=True)
    return pa.concat_arrays([words, pa.array([b""], pa.binary())]), np.insert(at, np.cumsum(n), len(words)), n + 1


class Layout:
    """Slots of tokens: the head by rank, others by page. Pages lie within buckets."""

    def __init__(self, head: list[bytes], buckets: int):
        self.size, self.array = len(head), pa.array(head, pa.binary())
        self.buckets, self.deal = buckets, -(-TAIL // buckets)
        self.pages = buckets * self.deal
        self.rows = min(ROWS_MOST, 1 << max(10, (len(head) - 1).bit_length()))
        rank = np.arange(len(head))
        shared = np.maximum(rank - OWN, 0) * MIDDLE // max(1, len(head) - OWN)
        own, mid, tail = OWN // CLASSES, MIDDLE // CLASSES, np.arange(self.pages) % TAIL
        self.own = rank < OWN
        self.head_slot = np.where(self.own, rank // own * MEMBERS + rank % own, shared // mid * MEMBERS + own + shared % mid)
        self.page_slot = tail % CLASSES * MEMBERS + own + mid + tail // CLASSES

    def page(self, h: np.ndarray) -> np.ndarray:
        """The page of keys by their crc32, which also names their bucket."""
        return h % self.buckets + self.buckets * ((mix64(h) >> np.uint64(20)).astype(np.int64) % self.deal)

    def places(self, words: pa.Array) -> np.ndarray:
        """Of each word its hash, its rank in the head (-1: none) and its page (-1: none), as columns."""
        rank = pc.index_in(words, value_set=self.array).fill_null(-1).to_numpy().astype(np.int64)
        some = words.to_pylist()
        h = np.fromiter(map(crc32, some), np.int64, len(some))
        key = h.copy()
        for i in np.flatnonzero(pc.binary_length(words).to_numpy() > KEY_BYTES):
            key[i] = crc32(token_key(some[i]))
        h[-1] = _END if some[-1] == b"" else h[-1]
        return np.stack([h, rank, np.where(rank < 0, self.page(key), -1)], 1)

    def slots(self, places: np.ndarray) -> np.ndarray:
        at, page = places[:, 1], places[:, 2]
        out = np.zeros(len(places), np.int64)
        out[at >= 0] = self.head_slot[at[at >= 0]]
        out[at < 0] = self.page_slot[page[at < 0]]
        return out


class Counts:
    """Training tokens of the head and of pages."""

    def __init__(self, layout: Layout, flat: np.ndarray | None = None):
        n = layout.size
        flat = np.zeros(n + layout.pages, np.int64) if flat is None else flat
        self.head, self.pages, self.total = flat[:n], flat[n:], int(flat.sum())
        slots = CLASSES * MEMBERS
        self.base = np.log10(self.head + 0.1)
        in_slot = np.bincount(layout.head_slot, weights=self.head + 0.1, minlength=slots)
        #: log10 of the third factor of tokens of the head, and of a page within its slot.
        self.head_share = np.where(layout.own, 0.0, self.base - np.log10(in_slot[layout.head_slot])) if n else np.empty(0)
        in_slot = np.bincount(layout.page_slot, weights=self.pages + 1.0, minlength=slots)
        self.page_share = np.log10((self.pages + 1.0) / in_slot[layout.page_slot])


class Weights:
    """Class rows, then member rows: the bias rows, then those of the three features."""

    def __init__(self, rows: int, a=None, b=None):
        self.rows = rows
        self.a = np.zeros((1 + 3 * rows, CLASSES), np.float32) if a is None else a
        self.b = np.zeros((CLASSES + 3 * rows, MEMBERS), np.float32) if b is None else b

    def copy(self) -> Weights:
        return Weights(self.rows, self.a.copy(), self.b.copy())

    def chunks(self) -> list[tuple[np.ndarray, int, int]]:
        return [(w, i, min(i + _CHUNK, len(w))) for w in (self.a, self.b) for i in range(0, len(w), _CHUNK)]


def features(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hashes of the three features of each token, good in the high bits; h: hashes of tokens, n: tokens of each text."""
    h = h.astype(np.uint64)
    first = np.zeros(len(h), bool)
    first[np.cumsum(n)[:-1]] = True
    first[:1] = True
    second = np.zeros(len(h), bool)
    second[1:] = first[:-1]
    one, two = np.empty_like(h), np.empty_like(h)
    one[1:], one[first] = h[:-1], _START
    two[1:], two[first | second] = one[:-1], _START
    out = np.stack([one, two + np.uint64(1 << 40), one | two << np.uint64(32)])
    out *= np.uint64(0x9E3779B97F4A7C15)
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out


def _rows(slot: np.ndarray, f: np.ndarray, rows: int) -> tuple[list, list]:
    """Rows of class weights and of member weights: bias and features."""
    cls, shift = slot // MEMBERS, np.uint64(64 - (rows - 1).bit_length())
    a = (f >> shift).astype(np.int64)
    b = ((f ^ (cls.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xA0761D6478BD642F) >> shift).astype(np.int64)
    starts = np.arange(3)[:, None] * rows
    return [None, *(a + starts + 1)], [cls, *(b + starts + CLASSES)]


def _softmax(w: np.ndarray, rows: list) -> np.ndarray:
    x = w.take(rows[1], axis=0)
    for r in rows[2:]:
        x += w.take(r, axis=0)
    x += w[0] if rows[0] is None else w.take(rows[0], axis=0)
    np.clip(x, -30, 30, out=x)  # in place of the maximum, which costs more than all the rest
    np.exp(x, out=x)
    x /= (x @ np.ones(x.shape[1], np.float32))[:, None]
    return x


def log10_probability(weights: Weights, slot: np.ndarray, h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of each token, the first two factors' log10 probability."""
    f = features(h, n)
    total = np.zeros(len(h))
    for s in range(0, len(h), BATCH):
        part = slice(s, s + BATCH)
        t = slot[part]
        a, b = _rows(t, f[:, part], weights.rows)
        e = np.arange(len(t))
        total[part] = np.log10(_softmax(weights.a, a)[e, t // MEMBERS] + 1e-30) + np.log10(_softmax(weights.b, b)[e, t % MEMBERS] + 1e-30)
    return total


def _sums(grad: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct row numbers and the sums of ``grad`` over each; short stretches (nearly all) by their first, second, .. rows."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    ordered, grad = rows[order], grad.take(order, axis=0)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    size = np.diff(np.append(first, len(rows)))
    out = grad.take(first, axis=0)
    left = np.flatnonzero(size > 1)
    for j in range(1, 8):
        out[left] += grad.take(first[left] + j, axis=0)
        left = left[size[left] > j + 1]
        if not len(left):
            return ordered[first], out
    ends = np.stack([first[left] + 8, first[left] + size[left]], 1).reshape(-1)
    out[left] += np.add.reduceat(grad, ends[:-1] if ends[-1] == len(grad) else ends, axis=0)[::2]
    return ordered[first], out


class Trainer:
    """AdaGrad with one step size for each row, from given weights; counts the batches that moved each row."""

    def __init__(self, weights: Weights):
        self.w = weights.copy()
        self.squares = (np.zeros(len(self.w.a), np.float32), np.zeros(len(self.w.b), np.float32))
        self.moved = (np.zeros(len(self.w.a), np.int32), np.zeros(len(self.w.b), np.int32))

    def learn(self, slot: np.ndarray, h: np.ndarray, n: np.ndarray) -> None:
        f = features(h, n)
        for s in range(0, len(h), BATCH):
            part = slice(s, s + BATCH)
            t = slot[part]
            for w, squares, moved, rows, want in zip((self.w.a, self.w.b), self.squares, self.moved, _rows(t, f[:, part], self.w.rows), (t // MEMBERS, t % MEMBERS), strict=True):
                grad = _softmax(w, rows)
                grad[np.arange(len(t)), want] -= 1
                for r in rows:
                    if r is None:
                        at, sums = np.zeros(1, np.int64), grad.sum(0, keepdims=True)
                    else:
                        at, sums = _sums(grad, r)
                    squares[at] += np.einsum("ij,ij->i", sums, sums) / sums.shape[1]
                    sums *= (STEP / np.sqrt(squares[at] + 1e-6))[:, None]
                    w[at] = w.take(at, axis=0) - sums
                    moved[at] += 1


_TRAINED = "chunk long, rows binary, moved binary, w binary"


def _chunk(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if i else pa.int64()) for i, v in enumerate(values)], [x.split()[0] for x in _TRAINED.split(", ")])


def _trained(weights, layout, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, trainer = layout.value, None
        counts = np.zeros(place.size + place.pages, np.int64)
        for b in slices(batches, text_col):
            trainer = trainer or Trainer(weights.value)
            words, at, n = tokens(column([b], text_col))
            places = place.places(words)
            seen = np.bincount(at, minlength=len(places))
            inside = places[:, 1] >= 0
            np.add.at(counts, np.where(inside, places[:, 1], place.size + places[:, 2]), seen)
            trainer.learn(place.slots(places)[at], places[at, 0], n)
        if trainer is None:
            return
        yield _chunk(_COUNTS, None, None, counts.tobytes())
        for c, (w, i, j) in enumerate(trainer.w.chunks()):
            moved = trainer.moved[0 if w is trainer.w.a else 1][i:j]
            some = np.flatnonzero(moved)
            if len(some):
                yield _chunk(c, pack(some.astype(np.uint16)), pack(moved[some]), pack(w[i:j][some].astype(np.float16).reshape(-1)))

    return run


def _averaged(dtype):
    """Weighted means of the chunks of a partition, in the form of :func:`_trained`; weights come as ``dtype``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        counts = None
        for b in batches:
            for c, rows, moved, w in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if c == _COUNTS:
                    new = np.frombuffer(w, np.int64)
                    counts = new.copy() if counts is None else counts + new
                    continue
                at, m = unpack(rows, np.uint16).astype(np.int64), unpack(moved, np.int32).astype(np.float64)
                x = unpack(w, dtype).reshape(len(at), -1).astype(np.float64)
                total, count = sums.setdefault(c, [np.zeros((_CHUNK, x.shape[1])), np.zeros(_CHUNK)])
                total[at] += x * m[:, None]
                count[at] += m
        if counts is not None:
            yield _chunk(_COUNTS, None, None, counts.tobytes())
        for c, (total, count) in sums.items():
            at = np.flatnonzero(count)
            yield _chunk(c, pack(at.astype(np.uint16)), pack(count[at].astype(np.int32)), pack((total[at] / count[at][:, None]).astype(np.float32).reshape(-1)))

    return run


def _crc(id_col: str):
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8"))


def _keys(texts: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """Distinct tokens that may be in the head, and how often each occurs."""
    words, at, _ = tokens(texts)
    some = np.flatnonzero(pc.binary_length(words).to_numpy() <= KEY_BYTES)
    return words.take(pa.array(some)).to_pylist(), np.bincount(at, minlength=len(words))[some]


def layout_of(docs: DataFrame, id_col="doc_id", text_col="text", head: int = HEAD) -> Layout:
    """Slots from the tokens' counts over all training texts."""
    buckets = partitions_of(docs)
    found = commonest_of_all(docs.where(_crc(id_col) % HELD_OUT != 0), text_col, buckets, _keys, head)
    return Layout([w for w, _ in found], buckets)


def train(docs: DataFrame, layout: Layout, id_col="doc_id", text_col="text", rounds: int = ROUNDS) -> tuple[Weights, Counts]:
    """Weights and counts from the training texts; round i takes those whose crc32 // 10 is i modulo ``rounds``."""
    spark = docs.sparkSession
    small_batches(spark)
    fan = int(layout.buckets**0.5) + 1  # a chunk's rows meet in so many groups, then once more
    crc, weights, place, total = _crc(id_col), Weights(layout.rows), spark.sparkContext.broadcast(layout), None
    for i in range(rounds):
        sent = spark.sparkContext.broadcast(weights)
        some = docs.where((crc % HELD_OUT != 0) & (F.floor(crc / HELD_OUT) % rounds == i)).select(text_col)
        moved = some.mapInArrow(_trained(sent, place, text_col), _TRAINED)
        moved = moved.repartition("chunk", F.pmod(F.spark_partition_id(), F.lit(fan))).mapInArrow(_averaged(np.float16), _TRAINED)
        means = moved.repartition("chunk").mapInArrow(_averaged(np.float32), _TRAINED).collect()
        weights = weights.copy()
        chunks = weights.chunks()
        for r in means:
            if r["chunk"] == _COUNTS:
                new = np.frombuffer(r["w"], np.int64)
                total = new if total is None else total + new
                continue
            w, a, b = chunks[r["chunk"]]
            at = unpack(r["rows"], np.uint16).astype(np.int64)
            w[a:b][at] = unpack(r["w"], np.float32).reshape(len(at), -1)
    return weights, Counts(layout, total)


def _postings(model, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, held, texts in blocks(batches, text_col):
            layout, weights, counts = model.value
            ids = ids_of(held, id_col)
            out = np.array([crc32(b"" if i is None else str(i).encode()) % HELD_OUT == 0 for i in ids])
            words, at, n = tokens(texts)
            places = layout.places(words)
            rank, page = places[:, 1], places[:, 2]
            inside = rank >= 0
            base, share, seen = np.zeros(len(words)), np.zeros(len(words)), np.zeros(len(words), np.int64)
            base[inside], share[inside], seen[inside] = counts.base[rank[inside]], counts.head_share[rank[inside]], counts.head[rank[inside]] > 0
            share[~inside] = counts.page_share[page[~inside]]
            lm = log10_probability(weights, layout.slots(places)[at], places[at, 0], n) + share[at]
            first = np.cumsum(n) - n
            table = {"doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(out), "n": pa.array(n), "base": np.add.reduceat(base[at], first), "score": np.add.reduceat(lm, first), "known": np.add.reduceat(seen[at], first)}
            yield header(block, layout.buckets, table)
            doc = np.repeat(np.arange(len(texts)), n)
            rest = ~inside[at]
            word, doc, freq = counted(at[rest], doc[rest])
            number = np.cumsum(~inside) - 1
            yield from rows_of(block, [token_key(w) for w in words.filter(pa.array(~inside)).to_pylist()], number[word], doc, freq << 1 | ~out[doc], layout.buckets)

    return run


SUMS = "block long, docs binary, base binary, third binary, known binary, head binary, distinct long"
_SUM_KINDS = [pa.int64(), *[pa.binary()] * 5, pa.int64()]


def _sum_row(*values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, _SUM_KINDS, strict=True)], [x.split()[0] for x in SUMS.split(", ")])


def _partial(model):
    """Of each block and document, over a task's buckets: sums of log10(c + 0.1), of the third factor, and of known tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layout, _, counts = model.value
        known, rows = Ids(), []
        for b in batches:
            for block, head, keys, sizes, docs, freqs in unpacked(b):
                if head is not None:
                    yield _sum_row(block, None, None, None, None, head, None)
                else:
                    rows.append((block, np.fromiter(map(known.__getitem__, keys), np.int32, len(keys)), sizes.astype(np.int32), docs.astype(np.uint16), freqs.astype(np.int32)))
        if not rows:
            return
        c = np.zeros(len(known), np.int64)
        for _, key, size, _, freq in rows:
            c += np.bincount(np.repeat(key, size), weights=(freq >> 1) * (freq & 1), minlength=len(c)).astype(np.int64)
        page = layout.page(np.fromiter(map(crc32, known), np.int64, len(known)))
        yield _sum_row(-1, None, None, None, None, None, int((c > 0).sum()))
        base = np.log10(c + 0.1)
        third = base - np.log10(counts.pages + 0.1 * (np.bincount(page, weights=c > 0, minlength=layout.pages) + 1))[page]
        by_block: dict[int, list] = {}
        for r in rows:
            by_block.setdefault(r[0], []).append(r)
        for block, some in sorted(by_block.items()):
            key = np.concatenate([np.repeat(r[1], r[2]) for r in some])
            docs = np.concatenate([r[3] for r in some]).astype(np.int64)
            freq = np.concatenate([r[4] for r in some]) >> 1
            for _, at, (x, y, z) in sums_by_block(docs, [freq * base[key], freq * third[key], freq * (c[key] > 0)]):
                yield _sum_row(block, pack(at), pack(x), pack(y.astype(np.float32)), pack(z.astype(np.int32)), None, None)

    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, distinct long"


def _summed(table: pa.Table) -> pa.Table:
    """A block's documents; of block -1 the number of distinct tokens."""
    rows = table.to_pylist()
    names, kinds = [x.split()[0] for x in _SCORED.split(", ")], [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
    head = next((r["head"] for r in rows if r["head"] is not None), None)
    if head is None:
        return pa.table([pa.array([v], k) for v, k in zip([None] * 6 + [sum(r["distinct"] for r in rows)], kinds, strict=True)], names=names)
    head = opened(head)
    base, score, known = (head[x].to_numpy().copy() for x in ("base", "score", "known"))
    for r in sorted((r for r in rows if r["head"] is None), key=lambda r: (r["docs"], r["base"], r["third"])):  # sums of floats in one order
        d = unpack(r["docs"], np.uint16)
        base[d] += unpack(r["base"], np.float64)
        score[d] += unpack(r["third"], np.float32)
        known[d] += unpack(r["known"], np.int32)
    return pa.table([head["doc_id"], head["held_out"], head["n"], pa.array(known), pa.array(base), pa.array(score), pa.nulls(len(base), pa.int64())], names=names)


def score(docs: DataFrame, id_col="doc_id", text_col="text", head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row. head: tokens whose counts
    are broadcast, whatever the input's size."""
    spark = docs.sparkSession
    small_batches(spark)
    layout = layout_of(docs, id_col, text_col, head)
    weights, counts = train(docs, layout, id_col, text_col)
    model = spark.sparkContext.broadcast((layout, weights, counts))
    small_batches(spark)
    postings = docs.select(id_col, text_col).mapInArrow(_postings(model, id_col, text_col), ROWS)
    sums = met(postings, layout.buckets).mapInArrow(_partial(model), SUMS)
    scored = materialize(sums.groupBy("block").applyInArrow(_summed, _SCORED), "lm-scores")
    distinct = scored.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0] + int((counts.head > 0).sum())
    floor = float(np.log10(counts.total + 0.1 * (distinct + 1)))
    return scored.where("distinct is null").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(counts.total).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(floor)).alias("base_score"), "score"
    )
