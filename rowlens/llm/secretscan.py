"""Secret scans: fixed patterns, and dictionary-primed zstandard novelty for what no pattern names.

A candidate is a run of 16 or more characters of ``A-Z a-z 0-9 + / _ = -`` holding both a letter and a digit,
whose line, or one next to it, names something sensitive; lines of nothing but a candidate, such as the body of a PEM
block, go on from the line before. Its novelty is its marginal size: the bytes
that a zstandard frame grows by when the candidate is appended to its surroundings (``AROUND`` bytes on each side), the
compressor being primed with a dictionary of code and identifier words and of the identifiers that the text itself
holds outside of candidates. Names, paths and repeated strings cost little; a key, drawn at
random, costs nearly its entropy. Candidates of at least ``NOVEL`` marginal bytes per character are reported.

Offsets are code points of the whole text. Base spans always stay; a novel span inside one is not
reported, one that only overlaps it is. Defined results: a null or empty text has no spans and the digest of the empty string; repeated rows give
repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from rowlens.llm.common import slices, small_batches, utf8, values

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that are long enough
LEAST = {"assign": 12, "access": 18}
HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
SENSITIVE = re.compile(rb"password|passwd|passphrase|secret|token|api_?key|private[_\x20-]?key|credential|bearer|authorization|signature")
WORDS_OF_SENSE = (b"pass", b"secret", b"token", b"key", b"credential", b"bearer", b"authorization", b"signature")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{16,}")
RUN_LINE = re.compile(rb"[\x20\t\"']*[A-Za-z0-9+/_=-]{16,}[\x20\t\r\\\"',]*")
#: Surrounding bytes on each side, and least marginal bytes for each character of a candidate.
AROUND, NOVEL = 64, 0.6
IDENTIFIER = re.compile(rb"[A-Za-z_][A-Za-z0-9_]{3,}")
#: Words of code and identifiers that prime the compressor.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key public_key credential bearer authorization signature session client_id client_secret "
    "user username email account config configuration settings environment variable value default string integer boolean number object function return import "
    "export const static public private protected class interface struct package module namespace include require true false null none undefined http https www "
    "com org net example localhost server client request response header content type application json xml html text charset encoding base64 sha256 md5 uuid "
    "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ getElementById addEventListener setAttribute documentation implementation initialization "
    "internationalization authentication transaction connection collection repository dependency version release build index path file directory folder name "
    "aaaaaaaaaaaaaaaa 0000000000000000 1111111111111111 xxxxxxxxxxxxxxxx XXXXXXXXXXXXXXXX ---------------- ________________ ================ "
)


class Novelty:
    def __init__(self, words: str = IDENTIFIERS, level: int = 3):
        primed = zstandard.ZstdCompressionDict(words.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.packer = zstandard.ZstdCompressor(level=level, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)

        self.words, self.level = words, level

    def with_words_of(self, text: bytes, candidates: list[tuple[int, int]]) -> Novelty:
        """The compressor primed with the identifiers of a text as well, those inside candidates left out."""
        rest, done = [], 0
        for s, e in candidates:
            rest.append(text[done:s])
            done = e
        mined = sorted(set(IDENTIFIER.findall(b"\n".join([*rest, text[done:]]))))
        return Novelty(f"{b' '.join(mined).decode()} {self.words}", self.level) if mined else self

    def marginal(self, before: bytes, candidate: bytes, after: bytes) -> int:
        return len(self.packer.compress(before + b"\n" + after + b"\n" + candidate)) - len(self.packer.compress(before + b"\n" + after + b"\n"))


def base_spans(text: bytes, low: bytes) -> list[tuple[int, int, int]]:
    """(first byte, kind, end) of the fixed patterns."""
    out = []
    if any(h in low for h in HINTS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST["assign"]]
    if b"AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def novel_spans(text: bytes, low: bytes, known: list, novelty: Novelty) -> list[tuple[int, int, int]]:
    """Candidates of enough novelty on a line that is, or is next to, one with a sensitive word, or that goes on from such
    a line in lines of nothing but a candidate."""
    if not any(w in low for w in WORDS_OF_SENSE):
        return []
    lines, at = [], 0
    for line in text.split(b"\n"):
        lines.append((at, at + len(line)))
        at += len(line) + 1
    named = [SENSITIVE.search(low, a, b) is not None for a, b in lines]
    if not any(named):
        return []
    some, body = [], False
    for i, (a, b) in enumerate(lines):
        alone = RUN_LINE.fullmatch(text, a, b) is not None
        near = named[i] or i > 0 and named[i - 1] or i + 1 < len(lines) and named[i + 1] or body and alone
        body = near and alone or named[i]
        if not near:
            continue
        for c in CANDIDATE.finditer(text, a, b):
            s, e = c.span()
            found = c[0]
            if re.search(rb"[0-9]", found) and re.search(rb"[A-Za-z]", found) and not any(x <= s and e <= y for x, _, y in known):
                some.append((s, e))
    if not some:
        return []
    novelty = novelty.with_words_of(text, [c.span() for c in CANDIDATE.finditer(text) if re.search(rb"[0-9]", c[0]) and re.search(rb"[A-Za-z]", c[0])])
    return [(s, 3, e) for s, e in some if novelty.marginal(text[max(0, s - AROUND) : s], text[s:e], text[e : e + AROUND]) >= NOVEL * (e - s)]


def spans(text: bytes, novelty: Novelty) -> list[tuple[int, int, int]]:
    """All spans as (start, kind, end) in code points, by start, then kind."""
    low = text.lower()
    base = base_spans(text, low)
    found = sorted([*base, *novel_spans(text, low, base, novelty)])
    if not found or text.isascii():
        return found
    at, last, point = {}, 0, 0
    for p in sorted({p for s, _, e in found for p in (s, e)}):
        point += len(text[last:p].decode("utf-8", "replace"))
        at[p], last = point, p
    return [(at[s], k, at[e]) for s, k, e in found]


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"


def digest(found: list[tuple[int, int, int]]) -> tuple:
    named = lambda some: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in some)
    count = [sum(k == kind for _, k, _ in found) for kind in range(4)]
    return *count[:3], hashlib.sha256(named(x for x in found if x[1] < 3).encode()).hexdigest(), named(found), count[3]


def scan(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """The digest of each row's spans."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        kinds = [*[pa.int64()] * 3, pa.string(), pa.string(), pa.int64()]
        for b in slices(batches, text_col):
            cols = zip(*(digest(spans(t, novelty)) for t in utf8(b, text_col)), strict=True)
            ids = b.column(b.schema.get_field_index(id_col)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA)


def redact_text(text: str, found: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each stretch of overlapping spans replaced by ``mark``."""
    out, done, merged = [], 0, []
    for s, _, e in found:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[done:s], mark]
        done = e
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text_col="text", chars_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns of ``docs``, secrets replaced in the text, ``chars_col`` counted anew where a text changes."""
    small_batches(docs.sparkSession)
    chars_col = chars_col if chars_col in docs.columns else None
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for b in slices(batches, text_col):
            cols, t = list(b.columns), b.schema.get_field_index(text_col)
            found = [spans(x, novelty) for x in utf8(b, text_col)]
            if any(found):
                texts = [redact_text(x, f) if f else x for x, f in zip(values(b, text_col), found, strict=True)]
                cols[t] = pa.array(texts, b.schema.field(t).type)
                if chars_col:
                    n = b.schema.get_field_index(chars_col)
                    cols[n] = pa.array([len(x) if f else c for x, f, c in zip(texts, found, values(b, chars_col), strict=True)], b.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return docs.mapInArrow(run, schema)
