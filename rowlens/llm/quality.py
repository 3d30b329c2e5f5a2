"""Quality rules judged by an isolation forest on rule statistics.

One pass over the texts counts the rules; everything after works on that narrow table. The forest's random
splits are drawn over the range of all labelled rows' statistics, on a log scale, and each tree is filled with rows from
a bounded sample of labelled good ones (``SAMPLE`` rows, those with the smallest hash of doc_id): a document whose
statistics are unusual soon stands alone, so its path is short. The verdict's threshold is
calibrated on *all* labelled rows: a histogram of their scores by label is aggregated in Spark, and the
threshold is the one that rejects most bad rows while it rejects at most ``SPARE`` of the good ones.

Defined results: a null or empty text has all counts 0 and fails the base rules; without labelled good rows, or
without labelled bad ones, there is no verdict and only the base rules decide; rows that share a doc_id are
judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.llm.common import materialize, slices, small_batches, utf8

SYMBOLS = b"#*$%&|<>"
#: Rows of the labelled sample that the forest is grown on, trees, rows of each tree, random seed.
SAMPLE, TREES, ROWS_OF_TREE, SEED = 20_000, 128, 256, 7
#: Share of labelled good rows that the verdict may reject; bins of the score histogram.
SPARE, BINS = 0.001, 2000
_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_UPPER = bytes(range(65, 91))
#: Rule statistics as shares, and the mean length of a word.
FEATURES = ("symbol_share", "repeat_share", "upper_share", "punct_share", "dup_line_share", "word_length")


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that the text holds at least twice."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    k = len(ids)
    if k < 2_000_000:
        codes = (a[:-2] * k + a[1:-1]) * k + a[2:]
    else:
        codes = np.unique(a[:-2] * k + a[1:-1], return_inverse=True)[1].reshape(-1) * k + a[2:]
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for j in range(3):
        covered[j : n - 2 + j] |= twice
    return int(covered.sum())


def measure(text: bytes) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the forest's features."""
    words = text.split()
    n = len(words)
    if not n:
        return (0, 0, len(text) - len(text.translate(None, SYMBOLS)), 0, 0, *[0.0] * len(FEATURES))
    inked = b"".join(words)
    chars = len(inked.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    rep = repeated_words(words)
    share = lambda of: (len(inked) - len(inked.translate(None, of))) / len(inked)
    return (n, chars, symbols, dup, rep, *(log1p(20 * x) for x in (symbols / n, rep / n, share(_UPPER), share(_PUNCT), dup / len(lines))), log1p(chars / n))


def _measured(id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            cols = list(zip(*map(measure, utf8(b, text_col)), strict=True))
            ids = b.column(b.schema.get_field_index(id_col)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, pa.float64()) for c in cols[5:])], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *FEATURES])

    return run


def statistics(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The rule counts and features of every row."""
    small_batches(docs.sparkSession)
    kinds = ", ".join(["doc_id long", *(f"{c} long" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), *(f"{c} double" for c in FEATURES)])
    return docs.select(id_col, text_col).mapInArrow(_measured(id_col, text_col), kinds)


class Forest:
    """Isolation trees as arrays: an inner node has a feature, a split and its left child; the right child follows."""

    def __init__(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, trees=TREES, size=ROWS_OF_TREE, seed=SEED):
        rng = np.random.default_rng(seed)
        self.size = min(size, len(rows))
        self.depth = 2 + int(np.ceil(np.log2(max(2, self.size))))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.size, replace=False)], low, high, rng) for _ in range(trees)]

    @staticmethod
    def _left(n: float) -> float:
        """Mean further path length in a random tree of n rows."""
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0

    def _grow(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, rng) -> tuple:
        feature, split, child, path = [-1], [0.0], [0], [0.0]
        todo = [(0, rows, low, high, 0)]
        while todo:
            at, part, low, high, depth = todo.pop()
            spread = np.flatnonzero(high > low)
            if depth >= self.depth or len(part) < 2 or not len(spread):
                path[at] = depth + self._left(len(part))
                continue
            f = int(rng.choice(spread))
            x = float(rng.uniform(low[f], high[f]))
            feature[at], split[at], child[at] = f, x, len(feature)
            below, above = high.copy(), low.copy()
            below[f] = above[f] = x
            for side in ((part[part[:, f] <= x], low, below), (part[part[:, f] > x], above, high)):
                todo.append((len(feature), *side, depth + 1))
                feature.append(-1), split.append(0.0), child.append(0), path.append(0.0)
        return np.array(feature), np.array(split), np.array(child), np.array(path)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly scores between 0 and 1: 2 to the power of minus the mean path length over the expected one."""
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, split, child, path in self.trees:
            at = np.zeros(len(rows), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                at = np.where(inner, child[at] + (rows[every, np.maximum(f, 0)] > split[at]), at)
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(1e-9, self._left(self.size)))


def _scored(forest):
    model = forest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = np.stack([b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in FEATURES], 1) if b.num_rows else np.empty((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.value.score(rows), pa.float64())], [*b.schema.names, "anomaly"])

    return run


def base_failed():
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def threshold(histogram: list, spare=SPARE) -> float | None:
    """The score above which documents go. histogram: rows (bin, good, bad) of labelled rows that pass the base rules."""
    good, bad = sum(r["good"] for r in histogram), sum(r["bad"] for r in histogram)
    if not good or not bad:
        return None
    best, at, g, b = 0, None, 0, 0
    rows = sorted(histogram, key=lambda r: -r["bin"])
    for r, below in zip(rows, [*rows[1:], None], strict=False):
        g, b = g + r["good"], b + r["bad"]
        if g > spare * good:
            break
        if b > best:
            best, at = b, (r["bin"] + (below["bin"] + 1 if below else r["bin"])) / 2 / BINS
    return at


def fit(stats: DataFrame, labels: DataFrame):
    """The broadcast forest and the verdict's threshold; None for what the labels don't give."""
    spark = stats.sparkSession
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = materialize(stats.where(~F.col("base_failed")).join(labels, "doc_id"), "quality-labelled")
    ends = labelled.agg(F.count_if(F.col("quality") == 1).alias("good"), *(f(c).alias(f"{n}_{c}") for n, f in (("low", F.min), ("high", F.max)) for c in FEATURES)).first()
    hashed = labelled.where(F.col("quality") == 1).select(F.xxhash64("doc_id").alias("h"), "doc_id", *FEATURES)
    least = lambda some: some.coalesce(8).orderBy("h", "doc_id", *FEATURES).limit(SAMPLE).collect()
    top = -(1 << 63) + int((1 << 64) * min(1.0, 2 * SAMPLE / max(1, ends["good"])))  # twice as many as wanted lie below
    sample = least(hashed if top >= 1 << 63 else hashed.where(F.col("h") < top))
    if len(sample) < min(SAMPLE, ends["good"]):
        sample = least(hashed)  # ids that many rows share
    if len(sample) < 2:
        return None, None
    low, high = (np.array([ends[f"{n}_{c}"] for c in FEATURES]) for n in ("low", "high"))
    forest = spark.sparkContext.broadcast(Forest(np.array([[r[c] for c in FEATURES] for r in sample]), low, high))
    scored = labelled.select(F.col("quality").cast("int").alias("quality"), *FEATURES).mapInArrow(_scored(forest), ", ".join(["quality int", *(f"{c} double" for c in FEATURES), "anomaly double"]))
    bins = F.floor(F.col("anomaly") * BINS).alias("bin")
    return forest, threshold(scored.groupBy(bins).agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")).collect())


def judge(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The rule counts of every row, ``base_failed``, ``anomaly`` (null without a forest) and ``kept``."""
    stats = materialize(statistics(docs, id_col, text_col).withColumn("base_failed", base_failed()), "quality-stats")
    forest, cut = fit(stats, labels)
    if forest is None:
        return stats.withColumn("anomaly", F.lit(None).cast("double")).withColumn("kept", ~F.col("base_failed"))
    scored = stats.mapInArrow(_scored(forest), ", ".join(f"`{n}` {t}" for n, t in [*stats.dtypes, ("anomaly", "double")]))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.lit(True) if cut is None else F.col("anomaly") <= cut))


def keep(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of ``docs`` that are kept, all columns. The texts are measured again instead of being shuffled."""
    forest, cut = fit(materialize(statistics(docs, id_col, text_col).withColumn("base_failed", base_failed()), "quality-stats"), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            rows = [measure(t) for t in utf8(b, text_col)]
            good = np.array([r[0] >= 50 and 100 * r[4] <= 50 * r[0] for r in rows])
            if forest is not None and cut is not None:
                good &= forest.value.score(np.array([r[5:] for r in rows], np.float64)) <= cut
            yield b.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)
