"""Licence scan by a positional rare-token index.

A template is a licence text as its key phrases in order, with the number of words that may lie between one and the next; a phrase is a run of
words that must stand consecutively.  The vocabulary of all templates is small and fixed, and its words' document frequencies are
counted over all documents.  For each phrase the index holds its rarest word (highest IDF) with its relative position; a scan looks up
only these anchor words in a text, turns each place into the phrase's start, intersects the other words' postings by relative
position, and verifies the phrase.  A template's key phrases are then put in order: each must start within its gap after the one before.
Its label needs all mandatory key phrases in order; the score is the largest share of a template's IDF weight, the other phrases
included, that a text has in order.

Defined cases: a null or empty text has no words and no labels, and score 0; repeated rows are scanned each on their
own; a very long text is scanned like any other; an empty table gives an empty result; when no document has a licence word, all words are
equally rare; columns of any name pass unchanged.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textcore import ALNUM, Block, Words, attach, codes_in, documents, per_block

#: Fixed values of the contract: the base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Fixed values, from public licence texts.  Of each label its key phrases in order, as (phrase, words that may lie between it and the
#: phrase before, mandatory).  The words are those of the scan: lower case, letters and digits only.
TEMPLATES = {
    "agpl": [("gnu affero general public license", 0, True), ("version 3", 12, False)],
    "agpl-text": [
        ("gnu affero general public license", 0, True), ("free copyleft license for software and other kinds of works", 60, True),
        ("specifically designed to ensure cooperation with the community", 10, False), ("network server software", 12, False),
    ],
    "apache-2.0": [("apache license", 0, True), ("version 2 0", 8, True)],
    "apache-2.0-notice": [
        ("licensed under the apache license version 2 0", 0, True), ("you may not use this file except in compliance with the license", 8, True),
        ("you may obtain a copy of the license at", 4, False), ("unless required by applicable law or agreed to in writing", 20, True),
        ("distributed on an as is basis", 10, False), ("without warranties or conditions of any kind", 4, True),
    ],
    "bsd": [("bsd license", 0, True)],
    "bsd-2-clause": [
        ("redistribution and use in source and binary forms with or without modification are permitted", 0, True), ("redistributions of source code must retain the above copyright notice", 16, True),
        ("redistributions in binary form must reproduce the above copyright notice", 24, True), ("this software is provided", 60, True), ("as is", 14, False),
        ("any express or implied warranties", 8, False), ("even if advised of the possibility of such damage", 160, True),
    ],
    "bsd-3-clause": [
        ("redistribution and use in source and binary forms with or without modification are permitted", 0, True), ("redistributions of source code must retain the above copyright notice", 16, True),
        ("redistributions in binary form must reproduce the above copyright notice", 24, True), ("may be used to endorse or promote products derived from this software", 60, True),
        ("without specific prior written permission", 6, True), ("this software is provided", 12, False), ("even if advised of the possibility of such damage", 180, False),
    ],
    "cc": [("creative commons attribution", 0, True)],
    "cc-by-nc": [("cc by nc", 0, True)],
    "cc-by-sa": [("cc by sa", 0, True)],
    "cc-text": [
        ("creative commons", 0, True), ("you are free to", 60, True), ("share copy and redistribute the material in any medium or format", 6, True),
        ("adapt remix transform and build upon the material", 8, False), ("you must give appropriate credit", 40, True),
    ],
    "cc0": [("cc0", 0, True)],
    "copyright": [("copyright", 0, True), ("all rights reserved", 20, True)],
    "eupl": [("european union public licence", 0, True)],
    "gpl-2.0": [("gnu general public license", 0, True), ("version 2", 24, True)],
    "gpl-3.0": [("gnu general public license", 0, True), ("version 3", 24, True)],
    "gpl-notice": [
        ("you can redistribute it and or modify it under the terms of the gnu general public license", 0, True), ("as published by the free software foundation", 4, True),
        ("either version", 4, False), ("or at your option any later version", 12, False), ("distributed in the hope that it will be useful but without any warranty", 12, True),
        ("merchantability or fitness for a particular purpose", 12, False), ("you should have received a copy of the gnu general public license", 16, False),
    ],
    "isc": [("isc license", 0, True)],
    "isc-text": [
        ("permission to use copy modify and or distribute this software for any purpose", 0, True), ("with or without fee is hereby granted", 4, True),
        ("the software is provided as is and the author disclaims all warranties", 30, True),
    ],
    "lgpl": [("gnu lesser general public license", 0, True)],
    "mit-text": [
        ("permission is hereby granted free of charge to any person obtaining a copy", 0, True), ("to deal in the software without restriction", 16, True),
        ("use copy modify merge publish distribute sublicense", 12, True), ("the above copyright notice and this permission notice shall be included", 40, True),
        ("the software is provided as is without warranty of any kind", 16, True), ("fitness for a particular purpose and noninfringement", 20, False),
        ("in no event shall the authors or copyright holders be liable", 6, False),
    ],
    "mpl": [("mozilla public license", 0, True)],
    "mpl-2.0-notice": [
        ("this source code form is subject to the terms of the mozilla public license", 0, True), ("if a copy of the mpl was not distributed with this file", 8, True),
        ("you can obtain one at", 4, False),
    ],
    "public-domain": [("released into the public domain", 0, True)],
    "unlicense": [
        ("this is free and unencumbered software released into the public domain", 0, True), ("anyone is free to copy modify publish use compile sell or distribute this software", 4, True),
        ("for any purpose commercial or non commercial and by any means", 20, False),
    ],
    "zlib-text": [
        ("this software is provided as is without any express or implied warranty", 0, True), ("permission is granted to anyone to use this software for any purpose", 40, True),
        ("the origin of this software must not be misrepresented", 40, True), ("altered source versions must be plainly marked as such", 40, True),
        ("this notice may not be removed or altered from any source distribution", 20, False),
    ],
}
#: A text of this many words a licence place or fewer counts as wholly about the licence.
DENSE = 50.0


@dataclass(frozen=True)
class Template:
    phrase: str
    words: tuple[bytes, ...]
    anchor: int


def all_phrases() -> list[str]:
    return list(dict.fromkeys([*BASE, *(p for parts in TEMPLATES.values() for p, _, _ in parts)]))


def vocabulary() -> list[bytes]:
    return sorted({w.encode() for p in all_phrases() for w in p.split()})


def word_places(low: bytes, starts: np.ndarray, ends: np.ndarray, word: bytes) -> np.ndarray:
    """Indexes of the words that equal ``word``: its byte places that are whole words."""
    places, at, n = [], low.find(word), len(word)
    while at >= 0:
        places.append(at)
        at = low.find(word, at + 1)
    if not places:
        return np.zeros(0, np.int64)
    place = np.array(places)
    index = np.searchsorted(starts, place)
    index[index == len(starts)] = 0
    return index[(starts[index] == place) & (ends[index] == place + n)]


def document_frequency(df: DataFrame, text: str = "text") -> tuple[int, dict[bytes, int]]:
    """Rows, and for each word of the templates' vocabulary the number of rows that have it."""
    known = vocabulary()
    joined = np.frombuffer(b" ".join(known), np.uint8)
    hashes, order = np.unique(Words(Block(joined, np.array([0, len(joined)]), 0), ALNUM).hashes(), return_index=True)

    def count(block: Block, _: pa.RecordBatch) -> pa.RecordBatch:
        words = block.lower().words(ALNUM)
        code = codes_in(words.hashes(), hashes)
        some = np.flatnonzero(code)
        pairs = np.unique((np.searchsorted(words.first, some, "right") - 1) * (len(known) + 1) + code[some])
        n = np.bincount(pairs % (len(known) + 1), minlength=len(known) + 1)
        n[0] = len(block)
        return pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int64()), pa.array(n, pa.int64())], names=["k", "n"])

    rows = df.select(text).mapInArrow(per_block(count, text), "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()
    got = {r.k: r.n for r in rows}
    return got.get(0, 0), {known[j]: got.get(i + 1, 0) for i, j in enumerate(order.tolist())}


def build_index(rows: int, frequency: dict[bytes, int]) -> tuple[list[Template], dict[bytes, float]]:
    """A template for each phrase with its rarest word as the anchor, and the IDF of each word."""
    idf = {w: math.log((rows + 1) / (n + 1)) + 1 for w, n in frequency.items()}
    out = []
    for p in all_phrases():
        words = tuple(w.encode() for w in p.split())
        out.append(Template(p, words, max(range(len(words)), key=lambda i: (idf[words[i]], -i))))
    return out, idf


def scan_block(block: Block, templates: list[Template]) -> tuple[Words, dict[str, np.ndarray]]:
    """Over a block: its words, and for each phrase the indexes of the words at which it starts."""
    low = block.lower()
    words, raw = low.words(ALNUM), low.data.tobytes()
    starts, ends, first = words.starts, words.ends, words.first
    postings: dict[bytes, np.ndarray] = {}
    found = {}
    for t in templates:
        anchor = t.words[t.anchor]
        if anchor not in postings:
            postings[anchor] = word_places(raw, starts, ends, anchor)
        begin = postings[anchor] - t.anchor
        begin = begin[(begin >= 0) & (begin + len(t.words) <= len(starts))]
        if len(begin) and len(t.words) > 1:
            doc = np.searchsorted(first, begin, "right") - 1
            begin = begin[begin + len(t.words) <= first[doc + 1]]
            for i, w in enumerate(t.words):
                if not len(begin):
                    break
                if i != t.anchor:
                    if w in postings:
                        begin = begin[np.isin(begin + i, postings[w])]
                    else:  # the word's posting at just these places
                        a, b = starts[begin + i].tolist(), ends[begin + i].tolist()
                        begin = begin[np.array([raw[x:y] == w for x, y in zip(a, b, strict=True)], bool)]
        if len(begin):
            found[t.phrase] = begin
    return words, found


def _within(spans: list[tuple[int, int]], places: list[int]) -> list[int]:
    """The places (ascending) that lie in a span, ends included."""
    out, k = [], 0
    reach = -1  # of the spans that start at or before the place
    spans = sorted(spans)
    for at in places:
        while k < len(spans) and spans[k][0] <= at:
            reach = max(reach, spans[k][1])
            k += 1
        if at <= reach:
            out.append(at)
    return out


def covered(parts: list[tuple[str, int, bool]], found: dict[str, list[int]], size: dict[str, int]) -> tuple[bool, list[str]]:
    """Whether a text has a template's mandatory key phrases in order and within their gaps, and which of its phrases stand in order.

    ``found`` has each phrase's starts, ascending.  A phrase is kept as the spans of words in which the next one may start; one that is left out
    widens them by its gap and its words.
    """

    def chain(parts: list[tuple[str, int, bool]], strict: bool) -> tuple[bool, list[str]]:
        first = parts[0][0]
        have, spans = [first], [(at + size[first],) * 2 for at in found.get(first, [])]
        for phrase, gap, mandatory in parts[1:]:
            places = _within([(lo, hi + gap) for lo, hi in spans], found.get(phrase, []))
            have += [phrase] if places else []
            kept = [] if mandatory and strict else [(lo, hi + gap + size[phrase]) for lo, hi in spans]
            spans = kept + [(at + size[phrase],) * 2 for at in places]
            if not spans:
                break
        return bool(spans), have

    some = next(k for k, (p, _, _) in enumerate(parts) if p in found)
    return some == 0 and chain(parts, True)[0], chain(parts[some:], False)[1]


FIELDS = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, places array<struct<phrase: string, word: bigint>>"


def scanner(templates: list[Template], idf: dict[bytes, float]):
    weight = {t.phrase: sum(idf[w] for w in t.words) for t in templates}
    size = {t.phrase: len(t.words) for t in templates}
    total = {k: sum(weight[p] for p, _, _ in parts) for k, parts in TEMPLATES.items()}
    with_phrase: dict[str, list[str]] = {}
    for label, parts in TEMPLATES.items():
        for p, _, _ in parts:
            with_phrase.setdefault(p, []).append(label)

    def compute(block: Block) -> list:
        words, found = scan_block(block, templates)
        n_words, n = words.counts(), len(block)
        places: list[list[tuple[int, str]]] = [[] for _ in range(n)]
        for phrase, begin in found.items():
            doc = np.searchsorted(words.first, begin, "right") - 1
            for d, at in zip(doc.tolist(), (begin - words.first[doc]).tolist(), strict=True):
                places[d].append((at, phrase))
        n_base, first, last = np.zeros(n, np.int64), [None] * n, [None] * n
        base_labels, labels, score = [""] * n, [""] * n, np.zeros(n)
        for d, own in enumerate(places):
            if not own:
                continue
            own.sort()
            base = [(at, p) for at, p in own if p in BASE]
            some = {BASE[p] for _, p in base}
            by_phrase: dict[str, list[int]] = {}
            for at, p in own:
                by_phrase.setdefault(p, []).append(at)
            best, texts = 1.0 if base else 0.0, set()
            for label in dict.fromkeys(x for p in by_phrase for x in with_phrase.get(p, ())):
                whole, parts = covered(TEMPLATES[label], by_phrase, size)
                if whole:
                    texts.add(label)
                best = max(best, sum(weight[p] for p in parts) / total[label])
            n_base[d] = len(base)
            if base:
                first[d], last[d] = base[0][0], base[-1][0]
            base_labels[d] = ",".join(sorted(some))
            labels[d] = ",".join(sorted(some | texts))
            # how much of a template is there, and how dense the places are
            score[d] = min(1.0, best) * min(1.0, 0.5 + 0.5 * DENSE * len(own) / max(1, int(n_words[d])))
        listed = pa.array([[{"phrase": p, "word": at} for at, p in own] for own in places], pa.list_(pa.struct([("phrase", pa.string()), ("word", pa.int64())])))
        return [n_words, n_base, pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base_labels, pa.string()), pa.array(labels, pa.string()), score, listed]

    return compute


def scan(df: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """Every row with one struct column of the fields above; ``places`` lists each phrase's starts in words from 0."""
    templates, idf = build_index(*document_frequency(df, text))
    return attach(df, FIELDS, scanner(templates, idf), text, name="licence")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    found, name = scan(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", *[F.col(name)[c].alias(c) for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")])
