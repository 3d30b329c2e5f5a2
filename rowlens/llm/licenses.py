"""License scans by template-markup matching.

A template is wording with markup: ``<<opt: ...>>`` may be absent (and may nest), ``<<var: n>>`` stands for up to
n words of any kind; all other words are mandatory and have to match exactly. The markup of public licence templates is read
as well: ``<<beginOptional>> .. <<endOptional>>``, and ``<<var;name=..;original=..;match=..>>``, whose pattern may be a
wildcard (``.+``, ``.*``, ``.{0,n}``: up to n words, ``VAR_WORDS`` at most) or wordings separated by ``|``. Templates are compiled into one
token automaton (Thompson construction, determinised lazily while texts are read), run from every place where a
template can begin; a text is accepted where mandatory wording matches word for word, whatever its optional and
replaceable regions hold. The phrases of the base labels are templates without markup.

Score: m / (m + 1) with m the mandatory words of the longest accepted template or phrase, 0 if none is accepted.

Defined results: a null or empty text has no words, no places, empty label strings and score 0; repeated rows give
repeated results; an empty table gives an empty result. Work is linear in a text's words times the longest template.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from rowlens.llm.common import slices, small_batches, utf8

#: Words that an unbounded wildcard may stand for, and bytes of a table of templates.
VAR_WORDS, TABLE_BYTES = 60, 16 << 20
TOKEN = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Phrases whose places are counted, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Templates of common licences and notices (public wording), with their labels.
TEMPLATES = (
    ("released under <<opt: the terms of>> the mit license", "mit"),
    ("licensed under <<opt: the terms of>> the mit license", "mit"),
    ("licensed under <<opt: the terms of>> the apache license <<opt: version>> 2 0", "apache-2.0"),
    ("licensed under <<opt: the terms of>> the <<opt: gnu>> general public license <<opt: as published by the free software foundation>> <<opt: either>> version <<var: 1>> <<opt: of the license>> <<opt: or at your option any later version>>", "gnu-gpl"),
    ("licensed under cc by nc <<var: 2>>", "cc-by-nc"),
    ("licensed under <<opt: a creative commons attribution>> cc by sa <<var: 2>>", "cc-by-sa"),
    ("copyright <<var: 12>> all rights reserved", "copyright-reserved"),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license <<opt: you may obtain a copy of the license at http www apache org licenses license 2 0>>",
        "apache-2.0-notice",
    ),
    (
        "is free software you can redistribute it and or modify it under the terms of the gnu <<opt: lesser>> <<opt: affero>> general public license as published by the free software foundation either version <<var: 2>> of the license or "
        "<<opt: at your option>> any later version",
        "gnu-gpl-notice",
    ),
    ("this source code form is subject to the terms of the mozilla public license <<opt: v>> <<opt: version>> 2 0", "mpl-2.0-notice"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice <<opt: including the next paragraph>> shall be included in all copies or substantial portions of the software "
        "<<opt: the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall <<var: 12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software>>",
        "mit-text",
    ),
    (
        "permission to use copy modify and <<opt: or>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "isc-text",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<opt: 1>> redistributions of source code must retain the above copyright notice "
        "this list of conditions and the following disclaimer <<opt: 2>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "<<opt: <<opt: 3>> neither the name of <<var: 12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission>>",
        "bsd-text",
    ),
)


_MARK = re.compile(r"<<\s*opt:|<<\s*beginOptional[^>]*>>|<<\s*endOptional[^>]*>>|<<\s*var[:;](?:[^>\"]|\"[^\"]*\")*>>|>>|[^\s<>]+", re.I)


def _replaceable(mark: str):
    """('var', n), or ('any', wordings) where a pattern lists them."""
    if n := re.fullmatch(r"<<\s*var:\s*(\d+)\s*>>", mark):
        return ("var", int(n[1]))
    said = re.search(r'match\s*=\s*"?([^;">]*)"?', mark)
    pattern = said[1].strip() if said else ".+"
    if wild := re.fullmatch(r"\.(?:[+*]\??|\{\d*,?(\d*)\})", pattern):
        return ("var", min(int(wild[1] or VAR_WORDS), VAR_WORDS))
    if re.search(r"[\[\](){}*+?^$\\.]", pattern):
        raise ValueError(f"unsupported pattern: {pattern[:60]}")
    return ("any", [w for x in pattern.split("|") if (w := [t.decode() for t in TOKEN.findall(x.lower().encode())])])


def parse(markup: str) -> list:
    """Words, ('opt', items), ('var', n) and ('any', wordings), in order."""
    stack: list[list] = [[]]
    for t in _MARK.findall(markup):
        low = t.lower().replace(" ", "")
        if low == "<<opt:" or low.startswith("<<beginoptional"):
            stack.append([])
        elif t == ">>" or low.startswith("<<endoptional"):
            if len(stack) < 2:
                raise ValueError(f"unbalanced markup: {markup[:60]}")
            done = stack.pop()
            stack[-1].append(("opt", done))
        elif low.startswith("<<var"):
            stack[-1].append(_replaceable(t))
        else:
            stack[-1] += [w.decode() for w in TOKEN.findall(t.lower().encode())]
    if len(stack) != 1:
        raise ValueError(f"unbalanced markup: {markup[:60]}")
    return stack[0]


def templates_of(table: DataFrame, markup_col="markup", label_col="label") -> tuple:
    """Templates from a table, such as the files of public licence templates. The table is broadcast with the automaton,
    so its size is checked; rows without markup or label, or that begin with a region, are refused."""
    size = table.selectExpr(f"coalesce(sum(octet_length({markup_col})), 0)").first()[0]
    if size > TABLE_BYTES:
        raise ValueError(f"{size} bytes of templates; at most {TABLE_BYTES} are allowed")
    return tuple(sorted((r[0], r[1]) for r in table.select(markup_col, label_col).distinct().collect()))


def mandatory(items: list) -> int:
    return sum(isinstance(x, str) for x in items)


class Automaton:
    """All templates as one automaton over words. Its deterministic states are made when a text first needs them;
    their number is bounded by the templates' positions met together, not by the texts' length."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES):
        self.labels = [label for _, label in (*phrases, *templates)]
        self.n_base = len(phrases)
        self.weight, self.step, self.any, self.eps, self.ends = [], [], [], [], {}
        starts = []
        for i, (markup, _) in enumerate((*phrases, *templates)):
            items = parse(markup)
            if not items or not isinstance(items[0], str):
                raise ValueError("a template begins with a mandatory word")
            self.weight.append(mandatory(items))
            starts.append(first := self._state())
            self.ends.setdefault(self._build(items, first), []).append(i)
        self.closed: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict] = []
        self.other: list[int] = []
        self.accepts: list[tuple] = []
        self.words = {w for s in self.step for w in s}
        self.start = self._dfa(frozenset(starts))
        self.first = {w for s in starts for w in self.step[s]}

    def _state(self) -> int:
        self.step.append({}), self.any.append(None), self.eps.append([])
        return len(self.step) - 1

    def _build(self, items: list, at: int) -> int:
        for x in items:
            after = self._state()
            if isinstance(x, str):
                self.step[at][x.encode()] = after
            elif x[0] == "opt":
                self.eps[at].append(after)
                inner = self._state()
                self.eps[at].append(inner)
                self.eps[self._build(x[1], inner)].append(after)
            elif x[0] == "any":
                for wording in x[1]:
                    inner = self._state()
                    self.eps[at].append(inner)
                    self.eps[self._build(wording, inner)].append(after)
            else:
                self.eps[at].append(after)
                for _ in range(x[1]):
                    self.any[at] = self._state()
                    at = self.any[at]
                    self.eps[at].append(after)
            at = after
        return at

    def _dfa(self, states: frozenset) -> int:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        key = frozenset(seen)
        if key not in self.closed:
            self.closed[key] = len(self.sets)
            self.sets.append(key)
            self.next.append({})
            self.other.append(-2)
            self.accepts.append(tuple(sorted(i for s in key for i in self.ends.get(s, ()))))
        return self.closed[key]

    def move(self, d: int, word: bytes) -> int:
        """The state after a word, -1 if there is none."""
        known = word in self.words
        t = self.next[d].get(word, -2) if known else self.other[d]
        if t == -2:
            to = {self.step[s][word] for s in self.sets[d] if word in self.step[s]} if known else set()
            to |= {self.any[s] for s in self.sets[d] if self.any[s] is not None}
            t = self._dfa(frozenset(to)) if to else -1
            if known:
                self.next[d][word] = t
            else:
                self.other[d] = t
        return t

    def find(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """(template, first word, word after the longest match), by first word."""
        out, first = [], self.first
        for p in [i for i, w in enumerate(words) if w in first]:
            d, ends = self.start, {}
            for i in range(p, len(words)):
                d = self.move(d, words[i])
                if d < 0:
                    break
                for a in self.accepts[d]:
                    ends[a] = i + 1
            out += [(a, p, e) for a, e in sorted(ends.items())]
        return out


def scan_text(text: bytes, auto: Automaton) -> tuple:
    words = TOKEN.findall(text.lower())
    found = auto.find(words)
    base = [p for a, p, _ in found if a < auto.n_base]
    name = lambda some: ",".join(sorted({auto.labels[a] for a, _, _ in some}))
    m = max((auto.weight[a] for a, _, _ in found), default=0)
    spans = ",".join(f"{auto.labels[a]}:{p}:{e}" for a, p, e in found)
    return len(words), len(base), min(base, default=None), max(base, default=None), name(x for x in found if x[0] < auto.n_base), name(found), m / (m + 1), spans


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places string"


def scan(docs: DataFrame, id_col="doc_id", text_col="text", templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """One row per row of ``docs``; ``places`` lists label:first word:end of all accepted regions."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = Automaton(templates, phrases)
        kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), pa.string()]
        for b in slices(batches, text_col):
            cols = zip(*(scan_text(t, auto) for t in utf8(b, text_col)), strict=True)
            ids = b.column(b.schema.get_field_index(id_col)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA)


def template_regex(markup: str) -> str:
    """The same template over words that one blank follows, as SQL engines match it (for the oracle)."""

    def of(items: list) -> str:
        return "".join(f"{x} " if isinstance(x, str) else f"(?:{of(x[1])})?" if x[0] == "opt" else f"(?:{'|'.join(map(of, x[1]))})" if x[0] == "any" else f"(?:[^ ]+ ){{0,{x[1]}}}" for x in items)

    return " " + of(parse(markup))
