"""Token counts: every distinct pre-token is encoded once, documents only carry pre-token frequencies.

1. The commonest pre-tokens of a bounded sample are encoded on the driver and broadcast with their piece counts.
2. Texts are read in blocks. A block adds up the broadcast counts itself; its other pre-tokens go, with the documents that
   hold them and how often, to the bucket of the pre-token (see :mod:`rowlens.llm.postings`).
3. A task that holds all of a bucket encodes each of its pre-tokens once (again only where it forgets them, after ``KNOWN``)
   and joins the counts to the frequencies; products are added up for each block and document, and the sums of a block
   meet in one small group. No token ids are kept, no text is shuffled and nothing is written but shuffle files.

The tokenizer drops white space before its pre-tokens are cut, so a text is first cut at ASCII white space and each
distinct piece is pre-tokenised by the library once per block. Pieces that hold the text of an added token are kept
whole, so that the library matches it as it would in the text.

Defined results: a null text is empty and has 0 tokens; rows that share a doc_id are counted one by one; an empty
table gives an empty result. The input has to be a deterministic plan, such as a scan: blocks are numbered by
partition and order.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowlens.llm.common import pack, partitions_of, small_batches, unpack
from rowlens.llm.postings import HEAD, ROWS, Ids, blocks, commonest, counted, header, ids_of, met, numbered, opened, rows_of, sums_by_block, unpacked

MODEL, LIMIT = "word_bpe_49k.json", 2048
#: Pre-tokens that a task remembers, and entries of a round of sums.
KNOWN, ROUND = 2_000_000, 2_000_000
#: A pre-token pattern over lower-case ASCII. It is used where it agrees with the library (see Pieces.agrees).
ASCII_PATTERN = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """The library's pre-tokens and piece counts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.added = [t.content.lower().encode() for t in self.tok.get_added_tokens_decoder().values()]
        self.marks = {a[:2] for a in self.added}
        self.ascii = None
        self.ascii = ASCII_PATTERN if self.agrees() else None

    def agrees(self) -> bool:
        """Whether the pattern cuts all words of two ASCII characters, and words around their pairs, as the library does."""
        some = [bytes([c]) for c in range(128) if not bytes([c]).isspace()]
        words = [a + b for a in some for b in some] + [b"aB1" + a + c + b"9z" for a in (b"'", b"-", b"_", b"4") for c in (b"s", b"ll", b"S", b"RE", b"x", b"'")]
        return self.pretokens(words) == [tuple(ASCII_PATTERN.findall(w.lower())) for w in words]

    def pretokens(self, words: list[bytes]) -> list[tuple[bytes, ...]]:
        """Words between white space as their pre-tokens; whole where an added token stands in one.

        ASCII words are cut by the tokenizer's own pattern, others by the library, many at a time."""
        out: list = [None] * len(words)
        rest = []
        whole = b" ".join(words).lower()
        marked = any(m in whole for m in self.marks)
        for i, w in enumerate(words):
            low = w.lower()
            if marked and any(m in low for m in self.marks) and any(a in w.decode("utf-8", "replace").lower().encode() for a in self.added):
                out[i] = (w,)
            elif self.ascii and w.isascii():
                out[i] = tuple(self.ascii.findall(low))
            else:
                rest.append(i)
        for a in range(0, len(rest), 1000):
            some = rest[a : a + 1000]
            line = self._normal(b" ".join(words[i] for i in some).decode("utf-8", "replace"))
            parts = line.split(" ")
            if len(parts) != len(some):  # a word holds white space of another kind
                for i in some:
                    word = self._normal(words[i].decode("utf-8", "replace"))
                    out[i] = tuple(word[x:y].encode() for _, (x, y) in self.tok.pre_tokenizer.pre_tokenize_str(word))
                continue
            ends, at = [], -1
            for p in parts:
                at += len(p) + 1
                ends.append(at)
            of: list[list[bytes]] = [[] for _ in some]
            k = 0
            for _, (x, y) in self.tok.pre_tokenizer.pre_tokenize_str(line):
                while x >= ends[k]:
                    k += 1
                of[k].append(line[x:y].encode())
            for i, x in zip(some, of, strict=True):
                out[i] = tuple(x)
        return out

    def _normal(self, text: str) -> str:
        return self.tok.normalizer.normalize_str(text) if self.tok.normalizer else text

    def count(self, pretokens: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tok.encode_batch_fast(pretokens, add_special_tokens=False)]


def _block(pieces: Pieces, head: dict[bytes, int], buckets: int, block: int, ids: list, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """A block's header, with the sums over the head, and its postings of other pre-tokens."""
    words, word, n = numbered(texts)
    word, doc, count = counted(word, np.repeat(np.arange(len(texts)), n))
    made, common, rest, size = Ids(), np.zeros(len(words), np.int64), [], np.zeros(len(words), np.int64)
    for i, parts in enumerate(pieces.pretokens(words.to_pylist())):
        for k in parts:
            p = head.get(k)
            if p is None:
                rest.append(made[k])
                size[i] += 1
            else:
                common[i] += p
    sums = np.bincount(doc, weights=count * common[word], minlength=len(texts)).astype(np.int64)
    table = {"doc_id": pa.array(ids, pa.int64()), "n_bytes": pc.binary_length(texts).cast(pa.int64()), "sum": pa.array(sums)}
    yield header(block, buckets, table)
    first, n, flat = np.cumsum(size) - size, size[word], np.array(rest, np.int64)
    at = np.repeat(first[word] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    yield from rows_of(block, list(made), flat[at], np.repeat(doc, n), np.repeat(count, n), buckets)


def _postings(path: str, head, buckets: int, id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = None
        for block, held, texts in blocks(batches, text_col):
            pieces = pieces or Pieces(path)
            yield from _block(pieces, head.value, buckets, block, ids_of(held, id_col), texts)

    return run


SUMS = "block long, docs binary, tokens binary, head binary"


def _partial(path: str):
    """Products of frequency and piece count, summed for each block and document of this task, in bounded rounds."""

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        if held:
            spots, products = (np.concatenate(x) for x in zip(*held, strict=True))
            for block, docs, (tokens,) in sums_by_block(spots, [products]):
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([pack(docs)], pa.binary()), pa.array([pack(tokens.astype(np.int64))], pa.binary()), pa.array([None], pa.binary())], ["block", "docs", "tokens", "head"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, known, held, n = None, {}, [], 0
        for b in batches:
            for block, head, keys, sizes, docs, freqs in unpacked(b):
                if head is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([block]), *[pa.array([None], pa.binary())] * 2, pa.array([head], pa.binary())], ["block", "docs", "tokens", "head"])
                    continue
                new = [k for k in keys if k not in known]
                if new:
                    pieces = pieces or Pieces(path)
                    if len(known) > KNOWN:
                        known, new = {}, keys
                    known.update(zip(new, pieces.count([k.decode() for k in new]), strict=True))
                held.append((block << 16 | docs, freqs * np.repeat(np.fromiter(map(known.__getitem__, keys), np.int64, len(keys)), sizes)))
                n += len(docs)
                if n > ROUND:
                    yield from flush(held)
                    held, n = [], 0
        yield from flush(held)

    return run


def _summed(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    head = opened(next(r["head"] for r in rows if r["head"] is not None))
    total = head["sum"].to_numpy().copy()
    for r in rows:
        if r["head"] is None:
            total[unpack(r["docs"], np.uint16)] += unpack(r["tokens"], np.int64)
    return pa.table({"doc_id": head["doc_id"], "n_bytes": head["n_bytes"], "n_tokens": pa.array(total)})


def count_tokens(docs: DataFrame, id_col="doc_id", text_col="text", path: str | None = None, limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of ``docs``. path: the tokenizer's file, on each machine;
    head: pre-tokens whose counts are broadcast, whatever the input's size."""
    spark = docs.sparkSession
    small_batches(spark)
    path, buckets = path or model_path(), partitions_of(docs)

    def sampled():
        pieces = Pieces(path)

        def count(texts: pa.Array) -> Counter:
            words, at, _ = numbered(texts)
            out = Counter()
            for n, parts in zip(np.bincount(at, minlength=len(words)).tolist(), pieces.pretokens(words.to_pylist()), strict=True):
                for k in parts:
                    out[k] += n
            return out

        return count

    common = [k for k, _ in commonest(docs, text_col, buckets, sampled, head)]
    known = spark.sparkContext.broadcast(dict(zip(common, Pieces(path).count([k.decode() for k in common]), strict=True)) if common else {})
    postings = docs.select(id_col, text_col).mapInArrow(_postings(path, known, buckets, id_col, text_col), ROWS)
    sums = met(postings, buckets).mapInArrow(_partial(path), SUMS)
    out = sums.groupBy("block").applyInArrow(_summed, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
