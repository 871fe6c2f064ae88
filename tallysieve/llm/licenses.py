"""License scans on a positional index of rare words in licence templates.

Template words are posted as (template, position).  A file's licence words with the
highest inverse document frequency over the whole corpus look up their postings; each hit
votes for a template and a relative position.  Each template's key word, the rarest of its
mandatory phrases, always votes, and every place that it votes for is a candidate: a label
needs its mandatory phrases, so none is missed.  Candidates are taken by falling number of
other rare words whose votes lie within ``SLACK`` words, and verified on the file's words
from ``SLACK`` before the template's first place to ``SLACK`` behind its last: the label
holds if enough template words occur there in order (their longest common subsequence), so
inserted, missing and changed words only lower the share, and the mandatory phrases stand
there.

Three short phrases give the base labels; the method's labels come on top.

Defined results: null counts as the empty text: no words, no labels, score 0;
repeated rows are judged alike; ties between places take the higher share; very long texts
are scanned whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallysieve.llm.textkit import Words, text_or_empty, word_chunks, words_of

#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label, notice text, mandatory phrases.
TEMPLATES = (
    ("mit-notice", "released under the mit license", ("mit license",)),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ("permission is hereby granted", "sublicense and or sell"),
    ),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    (
        "apache-2.0-notice",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        ("except in compliance with the license",),
    ),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2", ("general public license version 2",)),
    (
        "gpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ("free software", "gnu general public license as published"),
    ),
    (
        "agpl-notice",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        ("gnu affero general public license",),
    ),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", ("lesser general public license",)),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        ("with or without fee is hereby granted",),
    ),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ("mozilla public license",)),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at", ("eclipse public license",)),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software", ("obtaining a copy of the software and accompanying documentation",)),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ("alter it and redistribute it freely",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered software",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("attribution sharealike",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("attribution noncommercial",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", ("attribution noderivatives",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright",)),
    ("proprietary", "all rights reserved no part of this publication may be reproduced or transmitted in any form without prior written permission", ("all rights reserved",)),
)
RARE_WORDS, SLACK = 12, 16
LEAST_SHARE = 0.7


def _hashes(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    return words_of(data, np.array([0, len(data)])).hashes()


class Index:
    """Postings of template words, mandatory phrases and base phrases as word hashes."""

    def __init__(self, templates: tuple = TEMPLATES):
        self.labels = [t[0] for t in templates]
        self.words = [_hashes(t[1]) for t in templates]
        self.required = [[_hashes(p) for p in t[2]] for t in templates]
        self.base = [(_hashes(p), label) for p, label in BASE]
        self.vocabulary = np.unique(np.concatenate(self.words))
        self.masks: list[dict[int, int]] = []  # the template's positions of each word, as bits
        self.postings: dict[int, list[tuple[int, int]]] = {}
        for k, own in enumerate(self.words):
            mask: dict[int, int] = {}
            for at, h in enumerate(own.tolist()):
                self.postings.setdefault(h, []).append((k, at))
                mask[h] = mask.get(h, 0) | 1 << at
            self.masks.append(mask)


def places(h: np.ndarray, doc: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Where the phrase's words stand consecutively in one text."""
    n = len(h) - len(phrase) + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    at = np.flatnonzero(h[:n] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[h[at + k] == phrase[k]]
    return at[doc[at] == doc[at + len(phrase) - 1]]


def key_words(index: Index, idf: dict[int, float]) -> list[int]:
    """For each template the rarest word of its mandatory phrases."""
    return [min((int(h) for p in required for h in p), key=lambda h: (-idf.get(h, 0.0), h)) for required in index.required]


def in_order(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence of a template of ``size`` words and the words; a column of the table is one integer."""
    full = rest = (1 << size) - 1
    for w in words:
        mask = masks.get(w)
        if mask is not None:
            met = rest & mask
            rest = (rest + met | rest - met) & full
    return size - rest.bit_count()


def aligned(own: np.ndarray, at: np.ndarray, idf: dict[int, float], index: Index, keys: list[int]) -> list[tuple[str, float]]:
    """(label, share of template words in place) of the templates that a file holds.

    ``own`` is the file's word hashes, ``at`` the places of its licence words.
    """
    spots: dict[int, list[int]] = {}
    for i, h in zip(at.tolist(), own[at].tolist(), strict=True):
        spots.setdefault(h, []).append(i)
    rare = sorted(spots, key=lambda h: (-idf.get(h, 0.0), h))[:RARE_WORDS]
    votes: dict[int, list[np.ndarray]] = {}
    for h in rare:
        for k, j in index.postings[h]:
            if h != keys[k]:
                votes.setdefault(k, []).append(np.array(spots[h]) - j)
    best: dict[str, float] = {}
    for k, key in enumerate(keys):
        if key not in spots:
            continue
        shifts = np.unique(np.concatenate([np.array(spots[key]) - j for t, j in index.postings[key] if t == k]))
        near = [np.searchsorted(v, shifts + SLACK, side="right") > np.searchsorted(v, shifts - SLACK) for v in votes.get(k, [])]
        ranked = shifts[np.argsort(-np.sum(near, axis=0), kind="stable")] if near else shifts
        label, seen = index.labels[k], set()
        for shift in ranked.tolist():
            part = own[max(0, shift - SLACK) : shift + len(index.words[k]) + SLACK]
            if best.get(label) == 1.0:
                break
            if (same := part.tobytes()) not in seen:
                seen.add(same)
                share = _share(part, k, index)
                if share >= LEAST_SHARE:
                    best[label] = max(best.get(label, 0.0), share)
    return sorted(best.items())


def _share(part: np.ndarray, k: int, index: Index) -> float:
    """Template words in order in the part of a file; 0 without the mandatory phrases."""
    one = np.zeros(len(part), dtype=np.int64)
    if not all(len(places(part, one, p)) for p in index.required[k]):
        return 0.0
    return in_order(index.masks[k], len(index.words[k]), part.tolist()) / len(index.words[k])


def document_frequency(docs: DataFrame, index: Index) -> tuple[int, dict[int, int]]:
    """(texts, texts with each licence word) over all rows."""
    vocabulary = index.vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df = 0, np.zeros(len(vocabulary), dtype=np.int64)
        for batch in batches:
            for a, b, words in word_chunks(batch.column("text")):
                total += b - a
                doc, word = _licence_words(words, words.hashes(), vocabulary)[:2]
                df += np.bincount(np.unique(doc * len(vocabulary) + word) % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *range(len(vocabulary))], pa.int64()), pa.array([total, *df.tolist()], pa.int64())], names=["word", "n"])

    rows = docs.select(text_or_empty().alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r.word: r.n for r in rows}
    return counts.get(-1, 0), {int(h): counts.get(k, 0) for k, h in enumerate(vocabulary)}


def _licence_words(words: Words, h: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, vocabulary number, place) of each licence word."""
    if not len(h):
        return words.doc, words.doc, words.doc
    k = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    at = np.flatnonzero(vocabulary[k] == h)
    return words.doc[at], k[at], at


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    index = Index()
    total, df = document_frequency(docs, index)
    idf = {h: float(np.log((total + 1) / (n + 1))) for h, n in df.items()}
    keys = key_words(index, idf)
    is_key = np.isin(index.vocabulary, np.array(keys, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for _, _, words in word_chunks(batch.column("text")):
                h = words.hashes()
                begin = np.cumsum(words.counts) - words.counts
                docs_n = len(words.counts)
                base: list[set[str]] = [set() for _ in range(docs_n)]
                starts: list[list[int]] = [[] for _ in range(docs_n)]
                for phrase, label in index.base:
                    for i in places(h, words.doc, phrase).tolist():
                        d = int(words.doc[i])
                        base[d].add(label)
                        starts[d].append(i - int(begin[d]))
                doc, word, at = _licence_words(words, h, index.vocabulary)
                telling = set(doc[is_key[word]].tolist())
                cut = np.searchsorted(doc, np.arange(docs_n + 1))
                for d in range(docs_n):
                    found: list[tuple[str, float]] = []
                    if d in telling:
                        lo = int(begin[d])
                        found = aligned(h[lo : lo + int(words.counts[d])], at[cut[d] : cut[d + 1]] - lo, idf, index, keys)
                    score = max([0.5 if base[d] else 0.0, *(s for _, s in found)])
                    row = (len(starts[d]), min(starts[d], default=None), max(starts[d], default=None), ",".join(sorted(base[d])), ",".join(sorted(base[d] | {x for x, _ in found})), score, int(words.counts[d]))
                    for column, x in zip(out, row, strict=True):
                        column.append(x)
            names = ["n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_words"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["doc_id", *names])

    kind = dict(docs.dtypes)["doc_id"]
    found = docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, f"doc_id {kind}, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_words long")
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
