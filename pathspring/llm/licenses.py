"""License scans: phrases that stand in a text, and a set-similarity join with templates.

Base labels come from places where a phrase's words stand consecutively.

The method's labels: the distinct tokens of each template are ordered by their
number in the whole corpus, rarest first. Any run of as many words as the template
has, over the threshold, and ``BLOCK`` at least, is a block for it. A block meets a
template of m tokens if it holds c = ceil(threshold * m) of them. Then it
holds one of the template's m - c + 1 rarest (prefix filter), as a rarest token
further on leaves fewer than c (position filter): only such blocks are looked at. A
block with fewer than c words cannot meet it (length filter). The most that a block
holds is held by one that starts at a token, so a sliding count over the tokens'
places counts all blocks exactly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathspring.llm._store import arrow
from pathspring.llm._words import ALNUM_LOWER, U64, Words, slices

THRESHOLD = 0.8
BLOCK = 64
"""Words in a block at least."""

#: Phrases and labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: Openings of the notices of common licenses, and short licenses in full.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other "
        "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
        "and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied "
        "warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice "
        "and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software "
        "including all implied warranties of merchantability and fitness",
    ),
)


def _hashes(text: str) -> np.ndarray:
    return Words(pa.array([text]), ALNUM_LOWER).hash


class _Template:
    def __init__(self, label: str, tokens: np.ndarray, words: int, threshold: float, block: int):
        self.label, self.tokens = label, tokens  # rarest first
        self.block = max(block, math.ceil(words / threshold))
        self.need = max(1, math.ceil(threshold * len(tokens) - 1e-9))
        self.prefix = len(tokens) - self.need + 1


def _vocabulary(templates) -> np.ndarray:
    return np.unique(np.concatenate([_hashes(text) for _, text in templates] or [np.zeros(0, dtype=U64)]))


def token_counts(docs: DataFrame, templates=TEMPLATES, text_col: str = "text") -> dict[int, int]:
    """How often each template token stands in the corpus. The result has a row for each token of the templates at most."""
    vocabulary = _vocabulary(templates)

    def run(batches):
        total = np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                h = Words(part.column("text"), ALNUM_LOWER).hash
                at = np.searchsorted(vocabulary, h).clip(max=len(vocabulary) - 1)
                total += np.bincount(at[vocabulary[at] == h], minlength=len(vocabulary))
        yield pa.RecordBatch.from_pydict({"token": pa.array(vocabulary.view(np.int64)), "n": pa.array(total)})

    if not len(vocabulary):
        return {}
    counts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).transform(arrow(run, "token long, n long")).groupBy("token").agg(F.sum("n").alias("n"))
    return {r["token"]: r["n"] for r in counts.collect()}


class _Scanner:
    def __init__(self, phrases, templates, counts: dict[int, int], threshold: float, block: int):
        self.phrases = [(_hashes(text), label) for text, label in phrases if len(_hashes(text))]
        rank = {h: (counts.get(int(np.int64(h.view(np.int64))), 0), int(h)) for h in _vocabulary(templates)}
        self.templates = []
        for label, text in templates:
            words = _hashes(text)
            tokens = np.array(sorted({*words}, key=lambda h: rank[h]), dtype=U64)
            if 0 < len(tokens):
                self.templates.append(_Template(label, tokens, len(words), threshold, block))
        self.vocabulary = _vocabulary(templates)
        self.widest = max((t.block for t in self.templates), default=block)

    def scan(self, texts: pa.Array):
        """n_words, n_base, first_word, last_word, base_labels, labels, score for each text."""
        w = Words(texts, ALNUM_LOWER)
        n, h, docs = len(texts), w.hash, w.doc()
        local = np.arange(len(h)) - w.ptr[:-1][docs]
        stop = w.stop()
        n_base = np.zeros(n, dtype=np.int64)
        first, last = np.full(n, np.iinfo(np.int64).max), np.full(n, -1, dtype=np.int64)
        base = [set() for _ in range(n)]
        for words, label in self.phrases:
            at = np.flatnonzero(h == words[0])
            at = at[at + len(words) <= stop[at]]
            for j in range(1, len(words)):
                at = at[h[at + j] == words[j]]
            np.add.at(n_base, docs[at], 1)
            np.minimum.at(first, docs[at], local[at])
            np.maximum.at(last, docs[at], local[at])
            for d in np.unique(docs[at]):
                base[d].add(label)
        more, score = self._blocks(h, docs, w.counts)
        return w.counts, n_base, first, last, base, more, score

    def _blocks(self, h, docs, lengths):
        n = len(lengths)
        more, score = [set() for _ in range(n)], np.zeros(n)
        at = np.searchsorted(self.vocabulary, h).clip(max=max(0, len(self.vocabulary) - 1))
        known = np.flatnonzero(self.vocabulary[at] == h) if len(self.vocabulary) else np.zeros(0, dtype=np.int64)
        if not len(known):
            return more, score
        kh, kd = h[known], docs[known]
        kg = known + kd * self.widest  # places with a gap between texts, so that no block has words of two
        for t in self.templates:
            order = np.argsort(t.tokens)
            spot = np.searchsorted(t.tokens, kh, sorter=order).clip(max=len(t.tokens) - 1)
            place = order[spot]
            mine = (t.tokens[place] == kh) & (np.minimum(t.block, lengths[kd]) >= t.need)  # length filter
            place, at, doc = place[mine], kg[mine], kd[mine]
            hot = at[place < t.prefix]  # prefix and position filter
            near = np.searchsorted(hot, at - t.block, side="right") < np.searchsorted(hot, at + t.block)
            place, at, doc = place[near], at[near], doc[near]
            if not len(at):
                continue
            # a token counts in the blocks that start after its last place before, and at most a block before this one
            by_token = np.lexsort((at, place))
            before = np.full(len(at), -t.block, dtype=np.int64)
            again = place[by_token[1:]] == place[by_token[:-1]]
            before[by_token[1:][again]] = at[by_token[:-1][again]]
            first = np.searchsorted(at, np.maximum(before, at - t.block), side="right")
            held = np.cumsum(np.bincount(first, minlength=len(at)) - np.concatenate([[0], np.ones(len(at) - 1, dtype=np.int64)]))
            held[np.searchsorted(hot, at) == np.searchsorted(hot, at + t.block)] = 0
            np.maximum.at(score, doc, held / len(t.tokens))
            for d in np.unique(doc[held >= t.need]):
                more[d].add(t.label)
        return more, score


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row.

    score: the largest share of a template's tokens in a block that passes the
    filters, or else 0. block: words in a block at least. Null and empty texts have no words, empty labels, null
    places and score 0. Rows that repeat a doc_id are reported each; null ids stay;
    other columns are ignored; an empty table gives no rows.
    """
    counts = token_counts(docs, templates, text_col)

    def run(batches):
        scanner = _Scanner(phrases, templates, counts, threshold, block)
        for batch in batches:
            for part in slices(batch, "text"):
                n_words, n_base, first, last, base, more, score = scanner.scan(part.column("text"))
                join = lambda s: ",".join(sorted(s))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "n_words": pa.array(n_words, pa.int64()),
                        "n_base": pa.array(n_base),
                        "first_word": pa.array(first, pa.int64(), mask=n_base == 0),
                        "last_word": pa.array(last, pa.int64(), mask=n_base == 0),
                        "base_labels": [join(b) for b in base],
                        "labels": [join(b | m) for b, m in zip(base, more)],
                        "score": pa.array(score),
                    }
                )

    t = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return t.transform(arrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"))
