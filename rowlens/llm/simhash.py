"""SimHash near-dedup by generalised pigeonhole search.

Fingerprints. A bit is set if more than half of a text's word shingles (repeats included) have it set in their hash.
The hash is XXH64 with seed 42 of the shingle's UTF-8; wider fingerprints add scrambled copies of it.

Search. Equal fingerprints are one row (with its smallest id), so exact copies cost one row for each group. Over all
distinct fingerprints, ones and joint ones of the bits are counted; bits that go together are put into the same
partition, since a partition of independent bits splits rows best. A threshold T_i >= -1 for each partition, with
sum(T_i) = complete - m + 1, finds every pair within ``complete`` bits: some partition differs in at most T_i. The
thresholds come from dynamic programming over the estimated cost of each (rows probed, and pairs met, from the bits'
measured rates), and m from the cheapest result. A row is indexed under its partition's value and probes all
values within T_i.

Verification. Rows that meet under a value are compared in full; what comes out is not the pairs but edges that span
the linked rows (at most one less than rows). A value that more than ``BLOCK`` rows share is dealt into blocks, each
pair of which is a group of its own, so no task holds an unbounded group and no pair is missed. Pairs within ``within``
bits link; beyond ``complete`` bits (where ``within`` is larger) the plan is the cheapest of those under which a pair at
``within`` bits meets with a chance of at least ``RECALL``, however many rows there are.
Components are the smallest ids reachable, by alternating star contractions written to the shared folder.

Dropping rows. :func:`deduplicate` fingerprints the set of a text's shingles and takes links as candidates only. Its search is by
prefixes, whose cost grows with the texts, not with pairs of rows: the shingles of all sets are put in one order, and two sets of a
Jaccard similarity s share one of the first (1 - s) * size + 1 of each, so every such pair meets. Shingles that are common in a bounded
sample come last in the order, so that few rows meet under one; any order finds the same pairs. A group that meets gives a spanning
forest of its candidates, so rows that candidates connect are a class. Of a class all pairs are held to the Jaccard similarity asked
for, set against set: every candidate, and pairs that did not meet themselves. Only pairs that are connected already are left out.
Classes that are too large for a task are dealt by the sets' sizes, then into blocks, each pair of which is a group of its own. So a
link is missed only where no candidates connect its ends, beyond ``SLACK`` standard deviations of bits.

Defined results: a null or empty text has fingerprint 0 and links like any other; a text shorter than a shingle is
one shingle; null ids are ignored when a component takes its smallest id (null if all are); rows that share a doc_id
are separate rows of one component if their texts are near; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, comb, log, log1p, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.llm.common import ROW_KIND, free, materialize, mix64, partitions_of, remove, row_keyed, scratch, slices, small_batches, utf8

SEED, BLOCK = 42, 4096
#: Words of a text, and bytes of texts, that are hashed at once.
STRETCH, TEXT_BYTES = 20_000, 1 << 20
#: Least chance that a pair at the distance of a link meets, where the search is not complete to it.
RECALL = 0.96
#: Standard deviations beyond the bits expected at the similarity asked for, up to which a pair is a candidate.
SLACK = 4.0
#: Nearest candidates of a row that :func:`nearest` gives besides the spanning ones, if not told otherwise.
NEAREST = 3
#: Sets, and shingles in all, beyond which a class is dealt into blocks; a group holds two blocks.
CLASS_SETS, CLASS_SHINGLES = 4096, 1 << 20
#: Texts that are sampled for common shingles, the least share of them that makes one common, and how many there may be.
SAMPLED, COMMON_SHARE, COMMON = 16_384, 0.0005, 65_536
#: Groups that a task remembers, so as not to send one again.
KNOWN_GROUPS = 1 << 19
#: Groups that a component is dealt into where its smallest id goes back to its members.
SALTS = 16
#: The row key that near-dedup gives its input.
ROW = "__row"
#: Assumed seconds for a probed row and for a compared pair and word of 64 bits.
ROW_COST, PAIR_COST = 3e-6, 2e-9


def shingle_hashes(text: bytes, k: int) -> np.ndarray:
    words = text.lower().split()
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    out, h = np.empty(len(words) - k + 1, np.uint64), xxhash.xxh64_intdigest
    for i in range(0, len(out), STRETCH):  # a long text's words are joined a stretch at a time
        some = words[i : i + STRETCH + k - 1]
        joined, ends, at = b" ".join(some), [], -1
        for w in some:
            at += len(w) + 1
            ends.append(at)
        starts = [0, *(e + 1 for e in ends[: len(some) - k])]
        out[i : i + STRETCH] = [h(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :], strict=True)]
    return out


def fingerprints(texts: list[bytes], k: int, width: int = 1) -> np.ndarray:
    return prints_of([shingle_hashes(t, k) for t in texts], width)


def prints_of(hashes: list[np.ndarray], width: int = 1) -> np.ndarray:
    """Rows of ``width`` 64-bit words of lists of hashes, which are counted together, one byte of bits at a time."""
    out = np.zeros((len(hashes), width), np.uint64)
    some = np.flatnonzero([len(h) for h in hashes])
    if not len(some):
        return out
    n = np.array([len(hashes[i]) for i in some])
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    every = np.concatenate([hashes[i] for i in some])
    for w in range(width):
        lanes = (mix64(every + np.uint64(0x9E3779B97F4A7C15 * w & (1 << 64) - 1)) if w else every).astype(">u8").view(np.uint8).reshape(-1, 8)
        got = np.empty((len(some), 8), np.uint8)
        for j in range(8):
            ones = np.add.reduceat(np.unpackbits(np.ascontiguousarray(lanes[:, j])[:, None], axis=1), starts, axis=0, dtype=np.int32)
            got[:, j] = np.packbits(2 * ones > n[:, None], axis=1)[:, 0]
        out[some, w] = got.view(">u8")[:, 0].astype(np.uint64)
    return out


def _to_binary(fps: np.ndarray) -> pa.Array:
    size = 8 * fps.shape[1]
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(fps), [None, pa.py_buffer(fps.astype(">u8").tobytes())]).cast(pa.binary())


def _from_binary(col: pa.Array) -> np.ndarray:
    rows = b"".join(col.to_pylist())
    return np.frombuffer(rows, ">u8").astype(np.uint64).reshape(len(col), -1)


def fingerprint(docs: DataFrame, id_col="doc_id", text_col="text", k=3, width=1) -> DataFrame:
    """doc_id and fp (binary, big-endian) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, TEXT_BYTES):
            ids = b.column(b.schema.get_field_index(id_col)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, _to_binary(fingerprints(utf8(b, text_col), k, width))], ["doc_id", "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, "doc_id long, fp binary")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype(">u8").view(np.uint8), axis=1)


def bit_statistics(distinct: DataFrame, bits: int) -> tuple[int, np.ndarray]:
    """Rows, and how often each two bits are set together, over all of ``distinct``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((bits, bits)), 0
        for b in batches:
            x = _bits(_from_binary(b.column(0))[:, : bits // 64]).astype(np.float32) if b.num_rows else np.zeros((0, bits), np.float32)
            total += x.T @ x
            n += len(x)
        if n:
            flat = np.concatenate([total[np.triu_indices(bits)], [n]]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat)], ["at", "n"])

    rows = distinct.select("fp").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    flat = np.zeros(bits * (bits + 1) // 2 + 1)
    flat[rows["at"].to_numpy()] = rows["n"].to_numpy()
    both = np.zeros((bits, bits))
    both[np.triu_indices(bits)] = flat[:-1]
    return int(flat[-1]), both + np.triu(both, 1).T


def group_bits(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of nearly equal width: each begins with the bit most correlated to what is left and takes the bits closest to it."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(len(p))), []
    for i in range(m):
        width = len(left) // (m - i)
        group = [left.pop(int(np.argmax(corr[np.ix_(left, left)].sum(1))))]
        while len(group) < width:
            group.append(left.pop(int(np.argmax(corr[np.ix_(left, group)].sum(1)))))
        groups.append(sorted(group))
    return groups


def meeting(width: int, bits: int, distance: int, t: int) -> float:
    """Chance that a pair which differs in ``distance`` of ``bits`` bits differs in at most ``t`` of ``width``."""
    q = distance / bits
    return sum(comb(width, j) * q**j * (1 - q) ** (width - j) for j in range(t + 1))


def recall_of(groups: list[list[int]], thresholds: list[int], bits: int, distance: int) -> float:
    """Chance that a pair at this distance meets under some partition of a plan."""
    miss = 1.0
    for g, t in zip(groups, thresholds, strict=True):
        miss *= 1 - meeting(len(g), bits, distance, t)
    return 1 - miss


def allocate(n: int, both: np.ndarray, complete: int, words: int = 1, most: int = 2, within: int | None = None, recall: float = RECALL) -> tuple[list[list[int]], list[int], float]:
    """Partitions, thresholds and estimated seconds of the cheapest plan that finds all pairs within ``complete`` bits
    and, with ``within`` beyond that, at least the share ``recall`` of pairs at ``within`` bits, whatever n."""
    if within is not None and within > complete:
        return _allocate_with_recall(n, both, complete, words, most, within, recall)
    bits = len(both)
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    best = None
    narrow = -(-bits // 32)  # partitions of 32 bits at most
    for m in range(narrow, max(narrow, min(complete + 1, bits // 4)) + 1):
        groups = group_bits(n, both, m)
        cost = np.zeros((m, most + 2))
        for i, g in enumerate(groups):
            dist = np.ones(1)
            for q in differ[g]:
                dist = np.convolve(dist, [1 - q, q])
            for t in range(most + 1):
                probes = sum(comb(len(g), j) for j in range(t + 1))
                cost[i, t + 1] = n * probes * ROW_COST + n * n / 2 * dist[: t + 1].sum() * PAIR_COST * words * (2 if t else 1)
        need = complete + 1  # the sum of T_i + 1
        table = np.full(need + 1, np.inf)
        table[0], picks = 0, []
        for i in range(m):
            new, pick = np.full(need + 1, np.inf), np.zeros(need + 1, int)
            for t in range(min(most + 1, len(groups[i]), need) + 1):
                got = np.concatenate([np.full(t, np.inf), table[: need + 1 - t]]) + cost[i, t]
                better = got < new
                new[better], pick[better] = got[better], t
            table = new
            picks.append(pick)
        if table[need] < (best[2] if best else np.inf):
            at, thresholds = need, []
            for pick in reversed(picks):
                thresholds.append(int(pick[at]) - 1)
                at -= pick[at]
            best = groups, thresholds[::-1], float(table[need])
    if best is None:
        raise ValueError("no allocation of thresholds")
    return best


def _allocate_with_recall(n: int, both: np.ndarray, complete: int, words: int, most: int, within: int, recall: float) -> tuple[list[list[int]], list[int], float]:
    """The dynamic programme with a second budget: steps of the logarithm of the chance to miss a pair at ``within``."""
    bits, steps = len(both), 400
    p = np.diag(both) / max(n, 1)
    differ = 2 * p * (1 - p)
    step = -log(1 - recall) / steps
    need, best = complete + 1, None
    narrow = -(-bits // 32)
    for m in range(narrow, max(narrow, bits // 8) + 1):
        groups = group_bits(n, both, m)
        table = np.full((need + 1, steps + 1), np.inf)
        table[0, 0], picks = 0, []
        for g in groups:
            dist = np.ones(1)
            for q in differ[g]:
                dist = np.convolve(dist, [1 - q, q])
            new, pick = table.copy(), np.zeros(table.shape + (3,), int)
            pick[..., 0], pick[..., 1] = np.indices(table.shape)
            for t in range(min(most + 1, len(g))):
                probes = sum(comb(len(g), j) for j in range(t + 1))
                cost = n * probes * ROW_COST + n * n / 2 * dist[: t + 1].sum() * PAIR_COST * words * (2 if t else 1)
                gain = int(-log1p(-min(meeting(len(g), bits, within, t), 1 - 1e-12)) / step)
                for a in range(need + 1):
                    to = min(a + t + 1, need)
                    got = table[a] + cost
                    for lo, hi, at in ((0, max(0, steps - gain), None), (max(0, steps - gain), steps + 1, steps)):
                        if lo >= hi:
                            continue
                        if at is None:
                            better = got[lo:hi] < new[to, lo + gain : hi + gain]
                            where = lo + np.flatnonzero(better)
                            new[to, where + gain], pick[to, where + gain] = got[where], np.stack([np.full(len(where), a), where, np.full(len(where), t + 1)], 1)
                        else:
                            b = lo + int(np.argmin(got[lo:hi]))
                            if got[b] < new[to, at]:
                                new[to, at], pick[to, at] = got[b], (a, b, t + 1)
            table = new
            picks.append(pick)
        if table[need, steps] < (best[2] if best else np.inf):
            at, thresholds = (need, steps), []
            for pick in reversed(picks):
                a, b, t = pick[at]
                thresholds.append(int(t) - 1)
                at = int(a), int(b)
            best = groups, thresholds[::-1], float(table[need, steps])
    if best is None:
        raise ValueError("no allocation of thresholds")
    return best


def _probed(groups: list[list[int]], thresholds: list[int], words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            bits = _bits(_from_binary(b.column(0))[:, :words]).astype(np.int64)
            every = np.arange(b.num_rows)
            for i, (g, t) in enumerate(zip(groups, thresholds, strict=True)):
                if t < 0:
                    continue
                flips = [0] if t == 0 else [0, *(1 << j for j in range(len(g)))]
                if t > 1:
                    flips += [1 << j | 1 << k for j in range(len(g)) for k in range(j)]
                value = bits[:, g] @ (1 << np.arange(len(g), dtype=np.int64))
                for f in range(0, len(flips), 64):
                    some = np.array(flips[f : f + 64], np.int64)
                    keys = ((value[:, None] ^ some) | (i << 40)).reshape(-1)
                    probe = np.broadcast_to(some != 0, (len(value), len(some))).reshape(-1)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(probe), b.column(0).take(pa.array(np.repeat(every, len(some))))], ["key", "probe", "fp"])

    return run


def spanning(fps: np.ndarray, probe: np.ndarray, within: int, words: int = 0, similarity: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that connect what links within ``within`` bits, in a group that meets; two probes alone don't meet. With a
    similarity rows are nodes, whose sets' sizes have to allow it."""
    left = np.argsort(probe, kind="stable")
    a, b = [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = (np.bitwise_count(fps[left] ^ fps[at]).sum(1) if similarity is None else _bits_apart(fps, probe, at, left, words, similarity)) <= within
            if probe[at]:
                near &= ~probe[left]
            if near.any():
                new = left[near]
                a += [at] * len(new)
                b += new.tolist()
                todo += new.tolist()
                left = left[~near]
    return np.array(a, np.int64), np.array(b, np.int64)


_APART = 1 << 20


def _bits_apart(fps: np.ndarray, probe: np.ndarray, at, others, words: int, similarity: float) -> np.ndarray:
    """Differing bits of nodes; ``_APART`` for two probes and where the sizes of the sets rule the similarity out."""
    bits = np.bitwise_count(fps[others, :words] ^ fps[at, :words]).sum(-1, dtype=np.int64)
    one, two = fps[at, words], fps[others, words]
    return np.where((np.minimum(one, two) >= similarity * np.maximum(one, two) - 1e-9) & ~(probe[at] & probe[others]), bits, _APART)


def nearest(fps: np.ndarray, probe: np.ndarray, within: int, words: int, similarity: float, k: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs within ``within`` bits of a group that meets: a least spanning forest and each row's ``k`` nearest, so at
    most k + 1 for each row. Of all pairs across a cut of the group the nearest in bits is among them."""
    n, k = len(fps), NEAREST if k is None else k
    best, source, out = np.full(n, _APART), np.zeros(n, np.int64), np.ones(n, bool)
    a, b = [], []
    for _ in range(n):
        at = int(np.argmin(np.where(out, best, 2 * _APART)))
        if best[at] <= within:
            a.append(source[at]), b.append(at)
        out[at] = False
        bits = _bits_apart(fps, probe, at, slice(None), words, similarity)
        bits[at] = _APART
        near = np.flatnonzero(bits <= within)
        if len(near) > k:
            near = near[np.argpartition(bits[near], k)[:k]]
        a += [at] * len(near)
        b += near.tolist()
        closer = out & (bits < best)
        best[closer], source[closer] = bits[closer], at
    return np.array(a, np.int64), np.array(b, np.int64)


def _linked(within: int, words: int, similarity: float | None = None):
    names = ["a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            k = np.stack([t[c].to_numpy() for c in ("key", "lo", "hi")], 1)
            if not len(k):
                continue
            edges = np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1
            cut = int(edges[-1]) if len(edges) else 0
            rest = t.slice(cut)
            if cut:
                yield from groups(t.slice(0, cut), edges)
        if rest is not None and rest.num_rows:
            yield from groups(rest, np.array([rest.num_rows]))

    def named(col, a: list, b: list) -> Iterator[pa.RecordBatch]:
        if a and sum(map(len, a)):
            i, j = pa.array(np.concatenate(a)), pa.array(np.concatenate(b))
            yield pa.RecordBatch.from_arrays([col.take(i), col.take(j)], names)

    def groups(t: pa.Table, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
        col = t["fp"].combine_chunks()
        fps, probe = _from_binary(col), t["probe"].to_numpy()
        starts = np.concatenate([[0], edges[:-1]])
        a, b = [], []
        sizes = edges - starts
        two = starts[sizes == 2]
        if len(two):  # most groups that hold a pair at all
            if similarity is None:
                near = (np.bitwise_count(fps[two] ^ fps[two + 1]).sum(1) <= within) & ~(probe[two] & probe[two + 1])
            else:
                near = _bits_apart(fps, probe, two, two + 1, words, similarity) <= within
            a.append(two[near]), b.append(two[near] + 1)
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            x, y = spanning(fps[s : s + n], probe[s : s + n], within, words, similarity)
            a.append(x + s), b.append(y + s)
        yield from named(col, a, b)

    return run


def links(distinct: DataFrame, bits: int, complete: int, within: int, block: int = BLOCK) -> DataFrame | None:
    """Edges (a, b) between distinct fingerprints that span all groups of linked ones; None if there are under two."""
    n, both = bit_statistics(distinct, bits)
    if n < 2:
        return None
    groups, thresholds, _ = allocate(n, both, complete, bits // 64, within=within)
    return meetings(distinct, groups, thresholds, bits // 64, _linked(within, bits // 64), block)


def meetings(distinct: DataFrame, groups: list[list[int]], thresholds: list[int], words: int, linked, block: int = BLOCK) -> DataFrame:
    """The distinct edges that ``linked`` finds where rows meet under a value."""
    return met(distinct.select("fp").mapInArrow(_probed(groups, thresholds, words), "key long, probe boolean, fp binary"), linked, block)


def met(probes: DataFrame, linked, block: int = BLOCK) -> DataFrame:
    """The distinct edges that ``linked`` finds in groups of rows with one key."""
    heavy = materialize(probes.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block), "simhash-heavy")
    if heavy.limit(1).count():
        probes = probes.join(heavy, "key", "left").withColumn("parts", F.coalesce(F.ceil(F.col("n") / block), F.lit(1)).cast("int"))
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        probes = probes.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        probes = probes.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "probe", "fp")
    else:
        probes = probes.select("key", F.lit(0).alias("lo"), F.lit(0).alias("hi"), "probe", "fp")
    dealt = probes.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return dealt.mapInArrow(linked, "a binary, b binary").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges``; root is the smallest node reachable. Alternating star contractions."""
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "cc")
    while True:
        near = both(edges)
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = near.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.where("a != b").distinct(), "cc")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").union(low.select("a", F.col("m").alias("b")))
        small = materialize(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
        # done when all edges lead to a node that has none to a smaller one, and every node has one edge
        rest = small.join(small.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        many = 0 if rest else small.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        remove(edges), remove(large)
        edges = small
        if not rest and not many:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", k=3, width=1, complete=3, within=None) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    prints = materialize(fingerprint(docs, id_col, text_col, k, width), "simhash-fp")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    edges = links(distinct, 64 * width, complete, complete if within is None else within)
    if edges is None:
        return prints.join(distinct, "fp").select("doc_id", "fp", F.col("least").alias("component_id"))
    tree = components(edges)
    linked = tree.select(F.col("node").alias("fp"), "root").union(tree.select(F.col("root").alias("fp"), "root").distinct())
    rooted = linked.join(distinct, "fp").withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = distinct.join(rooted.join(smallest, ["root", "salt"]).select("fp", "component_id"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def bits_for(similarity: float, bits: int, slack: float = 2.0) -> int:
    """Differing bits expected of two sets of equal size with this Jaccard similarity, and ``slack`` standard deviations."""
    share = acos(2 * similarity / (1 + similarity)) / pi
    return int(bits * share + slack * (bits * share * (1 - share)) ** 0.5)


def common_shingles(keyed: DataFrame, k: int) -> np.ndarray:
    """Hashes of shingles that are common in a bounded sample (the first rows of each partition), the commonest last."""
    small_batches(keyed.sparkSession)
    each = -(-SAMPLED // partitions_of(keyed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = each
        for b in batches:
            for some in slices([b.slice(0, left)], "text", TEXT_BYTES):
                every = np.concatenate([np.unique(shingle_hashes(t, k)) for t in utf8(some, "text")])
                h, n = np.unique(every, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])
            left -= b.num_rows
            if left <= 0:
                return

    least = max(8, int(SAMPLED * COMMON_SHARE))
    counts = keyed.select("text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = counts.orderBy(F.desc("n"), "h").limit(COMMON).toArrow()["h"].to_numpy()
    return np.ascontiguousarray(found[::-1]).view(np.uint64)


def prefix(shingles: np.ndarray, similarity: float, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of a sorted set of hashes the first in the order of all sets that any set of at least the similarity shares one of:
    by hash, then common ones (sorted, each with its rank) by rank."""
    if len(common) and len(shingles):
        at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
        known = common[at] == shingles
        if known.any():
            shingles = np.concatenate([shingles[~known], shingles[known][np.argsort(rank[at[known]])]])
    n = len(shingles)
    return shingles[: n - ceil(similarity * n - 1e-6) + 1]


def _shingle_sets(keyed: DataFrame, k: int, width: int, similarity: float) -> DataFrame:
    """Of every row its key, id, hashes of text and other columns, node (fingerprint, size and 128-bit hash of its shingle set) and prefix."""
    by_rank = common_shingles(keyed, k)
    rank = np.argsort(by_rank, kind="stable")
    common = by_rank[rank]
    small_batches(keyed.sparkSession)
    kind = keyed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", TEXT_BYTES):
            sets = [np.unique(shingle_hashes(t, k)) for t in utf8(b, "text")]
            named = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in sets), ">u8").reshape(-1, 2).astype(np.uint64)
            size = np.array([len(x) for x in sets], np.uint64)
            nodes = _to_binary(np.concatenate([prints_of(sets, width), size[:, None], named], 1))
            first = [prefix(x, similarity, common, rank) for x in sets]
            first = pa.ListArray.from_arrays(np.cumsum([0, *map(len, first)]).astype(np.int32), np.concatenate(first).astype(np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in (ROW, "doc_id", "hash", "rest")), nodes, first], [ROW, "doc_id", "hash", "rest", "fp", "prefix"])

    return keyed.select(ROW, "doc_id", F.xxhash64("text").alias("hash"), "rest", "text").mapInArrow(run, f"{ROW} {ROW_KIND}, doc_id {kind}, hash long, rest long, fp binary, prefix array<long>")


def _sharing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, file, at), sorted by key, the groups of two and more, each named by its members so that shingles
    which the same rows share are one group."""
    rest, known = None, set()

    def groups(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff([*starts, t.num_rows])
        file, at = t["file"].to_numpy(), t["at"].to_numpy()
        names = np.add.reduceat(mix64(file.view(np.uint64) ^ mix64(at.view(np.uint64))), starts)
        new = []
        for i in np.flatnonzero(sizes > 1).tolist():
            if (name := int(names[i])) not in known:
                new.append(i)
                known.add(name)
        if len(known) > KNOWN_GROUPS:
            known.clear()
        if new:
            kept = np.zeros(len(starts), bool)
            kept[new] = True
            rows = np.repeat(kept, sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names[kept], sizes[kept]).view(np.int64)), pa.array(file[rows]), pa.array(at[rows])], ["key", "file", "at"])

    for b in batches:
        t = pa.Table.from_batches([b])
        if not t.num_rows:
            continue
        if rest and rest[0]["key"][0] == t["key"][0] == t["key"][-1]:
            rest.append(t)  # a group goes on
            continue
        t = pa.concat_tables([*(rest or []), t])
        key = t["key"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        if len(starts) > 1:
            yield from groups(t.slice(0, int(starts[-1])), starts[:-1])
        rest = [t.slice(int(starts[-1]))]
    if rest:
        yield from groups(pa.concat_tables(rest), np.zeros(1, np.int64))


def sharing(prints: DataFrame, distinct: DataFrame) -> DataFrame:
    """Groups (key, probe, fp) of distinct nodes that share a shingle of their prefixes."""
    nodes = distinct.select("fp", F.col("least.file").alias("file"), F.col("least.at").alias("at"))
    firsts = prints.select(ROW, "prefix").join(distinct.select(F.col("least").alias(ROW)), ROW, "left_semi")
    posts = firsts.select(F.explode("prefix").alias("key"), f"{ROW}.file", f"{ROW}.at").repartition("key").sortWithinPartitions("key")
    groups = posts.mapInArrow(_sharing, "key long, file long, at long").distinct()
    return materialize(groups.join(nodes, ["file", "at"]).select("key", F.lit(False).alias("probe"), "fp"), "simhash-met")


def similar(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets that connect all those with at least the Jaccard similarity. Where sides differ, only pairs across
    them are looked at. Every such pair is compared unless its ends are connected already."""
    size = np.array([len(x) for x in sets])
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]  # the empty set is like no other
    a, b = [], []
    if len(order) < 2:
        return np.array(a, np.int64), np.array(b, np.int64)
    size, side = size[order], side[order]
    flat = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1].reshape(-1)
    starts = np.cumsum(size) - size
    own = np.zeros(int(flat.max()) + 1, np.int32)
    both = bool(side.any() and not side.all())
    out, todo = np.ones(len(order), bool), []
    left, words, at_word, n = np.arange(len(order)), flat, starts, size  # sets not reached, some reached ones among them
    while True:
        there = out[left]
        if there.sum() * 2 < len(left):
            words = words[np.repeat(there, n)]
            left, n = left[there], n[there]
            at_word, there = np.cumsum(n) - n, there[there]
        if not there.any():
            break
        if not todo:
            todo = [left[int(np.argmax(there))]]
            out[todo[0]] = there[int(np.argmax(there))] = False
        at = todo.pop()
        i, j = np.searchsorted(n, similarity * size[at] - 1e-6), np.searchsorted(n, size[at] / similarity + 1e-6, "right")
        if not there[i:j].any():
            continue
        mine = flat[starts[at] : starts[at] + size[at]]
        own[mine] = 1
        end = at_word[j] if j < len(left) else len(words)
        same = np.add.reduceat(own[words[at_word[i] : end]], at_word[i:j] - at_word[i])
        own[mine] = 0
        near = there[i:j] & (same >= similarity * (size[at] + n[i:j] - same) - 1e-9)
        if both:
            near &= side[left[i:j]] != side[at]
        new = left[i:j][near]
        out[new] = False
        a += [order[at]] * len(new)
        b += order[new].tolist()
        todo += new.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def _places(tree: DataFrame, distinct: DataFrame, width: int, similarity: float) -> DataFrame:
    """Of each node in a class its row's key, the class and the groups it belongs to. Sizes of sets that are alike lie at most one
    level apart; a group of a large class holds a level and the next."""
    roots = tree.select(F.col("root").alias("node")).distinct()
    nodes = tree.select("node", "root").union(roots.select("node", F.col("node").alias("root")))
    size = F.conv(F.hex(F.substring("fp", 8 * width + 1, 8)), 16, 10).cast("long")
    nodes = distinct.join(nodes, distinct["fp"] == nodes["node"]).select("node", F.col("least").alias(ROW), "root", size.alias("size"))
    nodes = materialize(nodes, "simhash-class")
    parts = F.greatest(F.ceil(F.count("*") / CLASS_SETS), F.ceil(F.sum("size") / CLASS_SHINGLES)).cast("int").alias("parts")
    large = nodes.groupBy("root").agg(parts).where("parts > 1").select("root", F.lit(True).alias("large"))
    level = F.floor(F.log(F.greatest("size", F.lit(1))) / F.lit(-log(0.99 * similarity))).cast("int")
    nodes = nodes.join(F.broadcast(large), "root", "left").withColumn("level", F.explode(F.when(F.col("large"), F.array(level, level - 1)).otherwise(F.array(F.lit(0)))))
    dealt = nodes.where("large").groupBy("root", "level").agg(parts).where("parts > 1")
    nodes = nodes.join(F.broadcast(dealt), ["root", "level"], "left")
    own = F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int")
    place = lambda o: F.struct(F.least("own", o).alias("lo"), F.greatest("own", o).alias("hi"), (F.col("own") > o).alias("side"))
    return nodes.withColumn("own", own).select("node", ROW, "root", "level", F.transform(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), place).alias("places"))


def _sets_of(places: DataFrame, keyed: DataFrame, k: int) -> DataFrame:
    """Nodes with their sorted shingle hashes, once for each group they belong to."""
    small_batches(keyed.sparkSession)
    kept = ["node", "root", "level", "places"]
    kinds = "node binary, root binary, level int, places array<struct<lo: int, hi: int, side: boolean>>, shingles binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", TEXT_BYTES):
            sets = [np.unique(shingle_hashes(t, k)).tobytes() for t in utf8(b, "text")]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(sets, pa.binary())], [*kept, "shingles"])

    sets = keyed.select(ROW, "text").join(places, ROW).select(*kept, "text").mapInArrow(run, kinds)
    return sets.withColumn("place", F.explode("places")).select("root", "level", "place.lo", "place.hi", "place.side", "node", "shingles")


def _verified(sets: DataFrame, similarity: float) -> DataFrame:
    """Edges that connect all sets of a class with at least the Jaccard similarity ``similarity``."""

    def edges(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        side, nodes, shingles = zip(*held, strict=True)
        a, b = similar([np.frombuffer(x, np.uint64) for x in shingles], np.array(side), similarity)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in x], pa.binary()) for x in (a.tolist(), b.tolist())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            for *key, side, node, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != group:
                    if len(held) > 1:
                        yield from edges(held)
                    group, held = key, []
                held.append((side, node, shingles))
        if len(held) > 1:
            yield from edges(held)

    at = ["root", "level", "lo", "hi"]
    return sets.repartition(*at).sortWithinPartitions(*at).mapInArrow(run, "a binary, b binary")


def similar_sets(keyed: DataFrame, prints: DataFrame, distinct: DataFrame, k: int, similarity: float, width: int, within: int) -> DataFrame | None:
    """(node, root) over nodes that shingle sets of at least ``similarity`` link; None if there are under two nodes.

    What meets within ``within`` bits is a candidate; rows that candidates connect are a class, whose sets are compared."""
    if distinct.limit(2).count() < 2:
        return None
    classes = components(met(sharing(prints, distinct), _linked(within, width, similarity)))
    good = materialize(_verified(_sets_of(_places(classes, distinct, width, similarity), keyed, k), similarity), "simhash-good")
    return components(good)


def deduplicate(docs: DataFrame, id_col="doc_id", text_col="text", k=5, similarity=0.8, width=4, complete=24) -> DataFrame:
    """The rows of ``docs``, of each component of shingle sets with a Jaccard similarity of at least ``similarity`` one:
    the first by id (nulls first), text hash and the hash of the other columns. Rows are told apart by a key of their own, so
    those that share an id or have none are judged like any other."""
    within = max(complete, bits_for(similarity, 64 * width, SLACK))
    row = free(docs, ROW)
    rows = row_keyed(docs, row, "simhash-rows")
    rest = F.xxhash64(F.lit(0), *(F.col(f"`{c}`") for c in docs.columns if c not in (id_col, text_col)))
    keyed = rows.select(F.col(row).alias(ROW), F.col(id_col).alias("doc_id"), rest.alias("rest"), F.col(text_col).alias("text"))
    with scratch() as made:
        prints = materialize(_shingle_sets(keyed, k, width, similarity), "simhash-fp")
        distinct = materialize(prints.groupBy("fp").agg(F.min(ROW).alias("least")), "simhash-distinct")
        tree = similar_sets(keyed, prints, distinct, k, similarity, width, within)
        rooted = prints.withColumn("root", F.col("fp")) if tree is None else prints.join(tree, prints["fp"] == tree["node"], "left").withColumn("root", F.coalesce("root", "fp"))
        first = rooted.groupBy("root").agg(F.min(F.struct("doc_id", "hash", "rest", ROW)).alias("first"))
        kept = materialize(first.select(F.col(f"first.{ROW}").alias(ROW)), "simhash-kept")  # rows are told by their own key, never dealt by root
        losers = materialize(prints.select(ROW).join(kept, ROW, "left_anti").select(F.col(ROW).alias(row)), "simhash-losers")
        made.keep(losers)
    return rows.join(losers, row, "left_anti").drop(row)
