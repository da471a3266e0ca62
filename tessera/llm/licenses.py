"""License scans: phrases, and an exact set-similarity join of text blocks with notice templates.

Blocks are windows of words about as long as the template, at every word of the text, across line breaks, as
notices are wrapped; so words that are scattered over a long line are no notice.  A template is found in a block if at least ``CONTAINMENT``
of the template's distinct words are among the block's, and all of those that tell it from
similar notices (``TELLING``).  Words are put in one global order,
rarest first, by their document frequency over the whole corpus, and filters leave only blocks
that can reach the threshold, losing none:

* prefix: a template of ``k`` words that needs ``t`` of them shares one of its first ``k - t + 1``;
* length: with fewer than ``t`` known words around a prefix word, no block there can hold the template;
* positional: if that word is the first of the shared ones in the global order, the others are behind it, in the
  template and in the block, so both have to have ``t`` words from there on.

The templates' side is bounded by the list of templates, so it goes to the tasks; only word
counts of template words, one row a word, come back.  Both passes are without a shuffle of text.

Defined results: a null text counts as empty; no base place gives null first and last words and
empty labels; the score is 1 with a base place, else the largest containment found, else 0.
Repeated rows repeat results; only the id and text columns are read.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Share of a template's words that a block has to hold.
CONTAINMENT = 0.8

# Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notices of common licenses, each with its label.
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

#: Words of a template that a block has to hold, as notices of other licenses have the rest.
TELLING = {b"apache", b"mit", b"3", b"lesser", b"affero", b"mozilla", b"nc", b"sharealike"}
#: Words of a window for each word of the template.
WINDOW = 1.25

#: Bytes that separate words: ASCII besides digits and lower-case letters.
_WORDS = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Words of a text, ASCII letters in lower case."""
    return text.lower().translate(_WORDS).split()


class TemplateIndex:
    """Prefixes of the templates over the global word order."""

    def __init__(self, frequency: dict[bytes, int], templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT):
        sets = [(label, set(words_of(t.encode()))) for label, t in templates]
        self.spans = [math.ceil(WINDOW * len(words_of(t.encode()))) for _, t in templates]
        self.rank = {w: i for i, w in enumerate(sorted({w for _, s in sets for w in s}, key=lambda w: (frequency.get(w, 0), w)))}
        self.templates, self.prefix = [], {}
        for label, s in sets:
            order = sorted(s, key=self.rank.__getitem__)
            need = math.ceil(containment * len(order) - 1e-9)
            for place, w in enumerate(order[: len(order) - need + 1]):
                self.prefix.setdefault(w, []).append((len(self.templates), place))
            self.templates.append((label, order, s, need))

    def find_windows(self, words: list[bytes], telling: set[bytes] | frozenset[bytes] = frozenset()) -> dict[str, float]:
        """Labels of the templates that some window of *words* holds, with all their words among *telling*, each with the largest containment.

        A window that holds a template shares a prefix word with it; of all it shares, take the one that is first in
        the global order.  Windows around a place of that word can hold the template only if there are as many known
        words around it as are needed (length), and as many distinct ones from that word on in the global order
        (positional).  Places that do not reach this are left out, and windows are counted around the others.
        """
        known: list[int] = []
        ranks: list[int] = []
        near: dict[int, list[tuple[int, int]]] = {}
        for i, w in enumerate(words):
            rank = self.rank.get(w)
            if rank is None:
                continue
            for t, place in self.prefix.get(w, ()):
                near.setdefault(t, []).append((len(known), place))
            known.append(i)
            ranks.append(rank)
        found: dict[str, float] = {}
        for t, firsts in near.items():
            label, order, own, need = self.templates[t]
            span = self.spans[t]
            at = [known[k] for k, place in firsts if self._reaches(known, ranks, k, span, len(order) - place, need)]
            start = 0
            for k, i in enumerate(at):
                if k + 1 < len(at) and at[k + 1] - i < 2 * span:
                    continue
                most = _fullest(words[max(0, at[start] - span + 1) : i + span], own, own & telling, span, need)
                if most >= need:
                    found[label] = max(found.get(label, 0.0), most / len(order))
                start = k + 1
        return found

    @staticmethod
    def _reaches(known: list[int], ranks: list[int], k: int, span: int, left: int, need: int) -> bool:
        """Whether the known words around the *k*-th let a window of *span* words hold *need* of a template that has *left* words from there on."""
        low, high = bisect_right(known, known[k] - span), bisect_left(known, known[k] + span)
        if left < need or high - low < need:
            return False
        first = ranks[k]
        return len({r for r in ranks[low:high] if r >= first}) >= need


def _fullest(words: list[bytes], own: set[bytes], must: set[bytes], span: int, need: int) -> int:
    """The most distinct words of *own* in a window of *span* words that has all of *must*; 0 if fewer than *need*."""
    held = own.intersection(words)
    if len(held) < need or not must <= held:
        return 0
    places = [i for i, w in enumerate(words) if w in own]
    counts: dict[bytes, int] = {}
    first = most = 0
    for at in places:
        counts[words[at]] = counts.get(words[at], 0) + 1
        while places[first] <= at - span:
            w = words[places[first]]
            counts[w] -= 1
            if not counts[w]:
                del counts[w]
            first += 1
        if len(counts) > most and len(counts) >= need and must <= counts.keys():
            most = len(counts)
    return most


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """Starts, in words, of the base phrases and their labels."""
    flat, out = b" " + b" ".join(words) + b" ", []
    for phrase, label in PHRASES.items():
        sought = b" " + phrase.encode() + b" "
        at, counted, number = flat.find(sought), 0, 0
        while at >= 0:
            # words are counted on from the last place, so that all of them together take one pass
            number += flat.count(b" ", counted, at)
            counted = at
            out.append((number, label))
            at = flat.find(sought, at + 1)
    return out


def word_frequency(docs: DataFrame, text_column: str = "text", templates: list[tuple[str, str]] = TEMPLATES) -> dict[bytes, int]:
    """Documents that hold each template word; at most one row a template word reaches the driver."""
    import pyarrow as pa

    sought = {w for _, t in templates for w in words_of(t.encode())}

    def run(batches):
        for batch in batches:
            counts = Counter()
            for t in batch.column(0):
                counts.update(sought.intersection(words_of(t.as_py().encode())))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["w", "n"])

    counted = docs.select(text_of(docs, text_column).alias("_text")).mapInArrow(run, "w binary, n long")
    return {bytes(r.w): r.n for r in counted.groupBy("w").agg(F.sum("n").alias("n")).collect()}


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """One row a document: id, word and place counts, base labels, all labels and score."""
    import pyarrow as pa

    index = TemplateIndex(word_frequency(docs, text_column, templates), templates, containment)
    kind = docs.schema[id_column].dataType.simpleString()
    frame = docs.select(F.col(id_column).alias("_id"), text_of(docs, text_column).alias("_text"))

    def look(text: bytes) -> tuple:
        words = words_of(text)
        places = base_places(words)
        base = {label for _, label in places}
        more: dict[str, float] = {}
        if not index.prefix.keys().isdisjoint(words):
            more = index.find_windows(words, TELLING)
        starts = [at for at, _ in places]
        score = 1.0 if base else max(more.values(), default=0.0)
        return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more.keys())), score

    def run(batches):
        types = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64()]
        for batch in batches:
            rows = [look(t.as_py().encode()) for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], [id_column, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return frame.mapInArrow(run, f"`{id_column}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
