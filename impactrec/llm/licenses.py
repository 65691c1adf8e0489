"""License scans: places of fixed phrases, and text blocks that contain a template.

The template search is an exact set-similarity join of text blocks with license templates. Both
are sets of words; a block meets a template if it holds at least a given part of the template's
words, its telling words among them, close together. Words are ordered by frequency over the whole corpus, rarest first. A block can only meet
a template if it holds one of its first words in this order (prefix filter), has enough words
(length filter), and has enough words left after the first common one (positional filter); what
passes is compared in full. The templates, their words and the counts of those words are a fixed
small table and go to every task; the texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from impactrec.llm.words import ALNUM, Texts, Words, slices

#: Phrases and the labels they stand for.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

class Template(NamedTuple):
    """A notice and its label. ``must`` are the words that tell the license apart from its neighbours; a
    place with one of ``without`` speaks of a neighbour."""

    label: str
    text: str
    must: tuple[str, ...] = ()
    without: tuple[str, ...] = ()


#: Notices by which texts and programs state their license, and the paragraphs of license texts.
TEMPLATES = (
    Template("mit", "Released under the MIT License."),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies "
        "of the Software, and to permit persons to whom the Software is furnished to do so",
        must=("deal", "sublicense"),
    ),
    Template(
        "mit",
        "The Software is provided as is, without warranty of any kind, express or implied, including but not limited to "
        "the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the "
        "authors or copyright holders be liable for any claim, damages or other liability",
        must=("noninfringement",),
    ),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template(
        "apache-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        must=("basis", "conditions"),
    ),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3.", must=("3",), without=("lesser", "affero")),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2.", must=("2",), without=("lesser", "affero")),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation",
        must=("gnu", "general"), without=("lesser", "library", "affero"),
    ),
    Template(
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation",
        must=("gnu", "lesser"),
    ),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    Template(
        "cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        must=("attribution", "4"), without=("noncommercial", "sharealike", "noderivatives"),
    ),
    Template(
        "cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        must=("sharealike", "4"), without=("noncommercial", "noderivatives"),
    ),
    Template(
        "cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        must=("noncommercial", "4"), without=("sharealike", "noderivatives"),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
        must=("redistribution", "binary"),
    ),
    Template(
        "bsd",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission",
        must=("neither", "endorse"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
        must=("fee", "purpose"),
    ),
    Template(
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at",
        must=("mozilla", "2"),
    ),
    Template("unlicense", "This is free and unencumbered software released into the public domain."),
)

#: A template of fewer distinct words must be held in full.
SHORT = 12

_NOTICE = "struct<label string, first_word long, last_word long, containment double>"
_FOUND = pa.struct(
    [("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("containment", pa.float64())]
)


def _hashes(text: str) -> np.ndarray:
    return Words(Texts(pa.array([text])).lowered(), ALNUM).hash


@dataclass
class Index:
    """Templates as sorted arrays of word ranks (0 is the rarest word), with what the filters need."""

    vocabulary: np.ndarray  # sorted hashes
    rank: np.ndarray  # by place in the vocabulary
    labels: list[str]
    sets: list[np.ndarray]
    needed: list[int]
    span: list[int]  # words of a place in which a template is looked for
    must: list[set[int]]
    without: list[set[int]]
    first: dict[int, list[tuple[int, int]]]  # rank of a prefix word: templates and its place in them
    prefix: np.ndarray  # by rank


def vocabulary(templates: Sequence[Template]) -> np.ndarray:
    return np.unique(np.concatenate([_hashes(" ".join([t.text, *t.without])) for t in templates]))


def _members(words: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words are known, and the places of these."""
    place = np.minimum(np.searchsorted(known, words), len(known) - 1)
    hit = known[place] == words
    return hit, place[hit]


def word_counts(docs: DataFrame, known: np.ndarray) -> np.ndarray:
    """In how many texts each known word occurs, over all of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(known), np.int64)
        for batch in slices(batches, "text"):
            words = Words(Texts(batch.column("text")).lowered(), ALNUM)
            hit, place = _members(words.hash, known)
            keys = np.unique(words.text[hit] * len(known) + place)
            total += np.bincount(keys % len(known), minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(known))), pa.array(total)], names=["word", "n"])

    counted = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    out = np.zeros(len(known), np.int64)
    for row in counted.collect():
        out[row["word"]] = row["n"]
    return out


def build_index(templates: Sequence[Template], known: np.ndarray, counts: np.ndarray, threshold: float) -> Index:
    order = np.lexsort((known, counts))
    rank = np.empty(len(known), np.int64)
    rank[order] = np.arange(len(known))
    ranks = lambda text: rank[np.searchsorted(known, _hashes(text))]
    labels, sets, needed, span, must, without, first = [], [], [], [], [], [], {}
    prefix = np.zeros(len(known), bool)
    for number, template in enumerate(templates):
        members = np.unique(ranks(template.text))
        least = len(members) if len(members) < SHORT else int(np.ceil(threshold * len(members) - 1e-9))
        labels.append(template.label)
        sets.append(members)
        needed.append(least)
        span.append(2 * len(_hashes(template.text)))
        must.append(set(ranks(" ".join(template.must)).tolist()))
        without.append(set(ranks(" ".join(template.without)).tolist()))
        for place, word in enumerate(members[: len(members) - least + 1].tolist()):
            first.setdefault(word, []).append((number, place))
            prefix[word] = True
    return Index(known, rank, labels, sets, needed, span, must, without, first, prefix)


def _blocks(texts: Texts, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First and last word (exclusive) of each block: the lines, and the paragraphs of several lines."""
    starts, ends = texts.lines()
    owner = texts.owner(np.minimum(starts, max(0, len(texts.data) - 1)))
    first, last = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    full = last > first
    # A paragraph ends where a line has no word, or where the text ends.
    breaks = np.cumsum(~full) * 2 * (texts.n + 1) + owner
    f, l, b = first[full], last[full], breaks[full]
    if not len(f):
        return f, l
    new = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    begin, end = f[new], l[np.concatenate([new[1:], [len(f)]]) - 1]
    several = np.diff(np.concatenate([new, [len(f)]])) > 1
    return np.concatenate([f, begin[several]]), np.concatenate([l, end[several]])


def _candidates(block: np.ndarray, distinct: int, index: Index) -> list[int]:
    """Templates of which a block, given as sorted ranks of its known words, holds enough words."""
    seen, out = set(), []
    for place, word in enumerate(block.tolist()):
        for number, position in index.first.get(word, ()):
            if number in seen:
                continue
            seen.add(number)  # the first common word: later ones leave less
            size, least = len(index.sets[number]), index.needed[number]
            if distinct < least or min(size - position, len(block) - place) < least:
                continue
            if len(np.intersect1d(block, index.sets[number], assume_unique=True)) >= least:
                out.append(number)
    return out


def _containment(ranks: np.ndarray, number: int, index: Index) -> float:
    """The largest part of a template that a place of twice its length holds, with its telling words and
    without those of neighbours; 0 if no place holds enough. ``ranks`` are the words of a block, -1 for unknown ones."""
    members, must, without = set(index.sets[number].tolist()), index.must[number], index.without[number]
    at = np.flatnonzero(np.isin(ranks, [*members, *without]))
    words = ranks[at].tolist()
    ends = np.searchsorted(at, at + index.span[number]).tolist()
    best = 0
    for start, end in enumerate(ends):
        if words[start] in members and end - start > max(best, index.needed[number] - 1):
            held = set(words[start:end])
            common = len(held & members)
            if common > best and common >= index.needed[number] and must <= held and not without & held:
                best = common
    return best / len(members)


def scan(
    docs: DataFrame,
    phrases: Mapping[str, str] = PHRASES,
    templates: Sequence[Template] = TEMPLATES,
    threshold: float = 0.8,
) -> DataFrame:
    """Phrases and notices in every row: ``doc_id, n_words, n_base, first_word, last_word, base, notices``.

    ``first_word`` and ``last_word`` are the smallest and largest starts of phrases, null without
    any; ``base`` holds their distinct labels. ``notices`` lists each block (a line, or a paragraph
    of several lines) with a place, of twice as many words as a template, that holds at least
    ``threshold`` of the template's distinct words (all of fewer than 12), its telling words among them
    and none of its neighbours': the block's first and last word and the part that the best place holds. Null texts count as empty; nothing is found in
    them. Equal texts get equal results.
    """
    known = vocabulary(templates)
    index = build_index(templates, known, word_counts(docs, known), threshold)
    goals = [(label, _hashes(phrase)) for phrase, label in phrases.items()]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = Texts(batch.column("text")).lowered()
            words = Words(texts, ALNUM)
            n_base = np.zeros(texts.n, np.int64)
            smallest = np.full(texts.n, np.iinfo(np.int64).max)
            largest = np.full(texts.n, -1)
            base: list[set[str]] = [set() for _ in range(texts.n)]
            for label, goal in goals:
                size = len(words.hash) - len(goal) + 1
                if size <= 0:
                    continue
                at = np.flatnonzero(words.hash[:size] == goal[0])
                at = at[words.text[at] == words.text[at + len(goal) - 1]]
                for k in range(1, len(goal)):
                    at = at[words.hash[at + k] == goal[k]]
                own = words.text[at]
                n_base += np.bincount(own, minlength=texts.n)
                np.minimum.at(smallest, own, at - words.first[own])
                np.maximum.at(largest, own, at - words.first[own])
                for text in np.unique(own).tolist():
                    base[text].add(label)
            notices: list[list[dict]] = [[] for _ in range(texts.n)]
            hit, place = _members(words.hash, index.vocabulary)
            ranks = np.full(len(words.hash), -1)
            ranks[hit] = index.rank[place]
            marked = np.zeros(len(ranks) + 1, np.int64)
            np.cumsum((ranks >= 0) & index.prefix[ranks], out=marked[1:])
            first, last = _blocks(texts, words)
            for b in np.flatnonzero(marked[last] > marked[first]).tolist():
                f, l = int(first[b]), int(last[b])
                block = np.unique(ranks[f:l])
                text = int(words.text[f])
                for number in _candidates(block[block >= 0], len(np.unique(words.hash[f:l])), index):
                    if not (part := _containment(ranks[f:l], number, index)):
                        continue
                    begin = int(words.first[text])
                    notices[text].append(
                        {
                            "label": index.labels[number], "first_word": f - begin, "last_word": l - 1 - begin,
                            "containment": part,
                        }
                    )
            none = n_base == 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), pa.array(words.counts), pa.array(n_base),
                    pa.array(smallest, mask=none), pa.array(largest, mask=none),
                    pa.array([sorted(x) for x in base], pa.list_(pa.string())), pa.array(notices, pa.list_(_FOUND)),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base", "notices"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        find,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base array<string>, "
        f"notices array<{_NOTICE}>",
    )


def digest(found: DataFrame) -> DataFrame:
    """One row of labels per document: ``base_labels``, ``labels`` and ``score``, the largest part of a
    template that a block holds (0 if none meets one)."""
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("notices", lambda x: x["label"]))))
    score = F.coalesce(F.array_max(F.transform("notices", lambda x: x["containment"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), score.alias("score"),
        F.size("notices").cast("long").alias("n_notices"),
    )
