"""License scans: base phrases, and an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlake.llm import textscan
from twinlake.session import bound_batches

CONTAINMENT = 0.8

#: Phrases whose words must stand consecutively, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices of public licenses, and their labels.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]


def template_sets(templates: list[tuple[str, str]], key: int = 0) -> tuple[np.ndarray, list[np.ndarray]]:
    """All tokens of the templates (sorted hashes) and each template as places in them."""
    sets = [np.unique(textscan.hash_words(text, "alnum", key)) for _, text in templates]
    tokens = np.unique(np.concatenate(sets))
    return tokens, [np.searchsorted(tokens, s) for s in sets]


def _blocks(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The first bytes of text blocks: rows begin one, and so do lines after a blank line."""
    lines = np.flatnonzero(values == 10)
    if len(lines) < 2:
        return np.unique(offsets[:-1])
    ink = np.append(0, np.cumsum(textscan.word_class("blank")[values]))
    gap = ink[lines[1:]] == ink[lines[:-1]]
    return np.unique(np.concatenate([offsets[:-1], lines[1:][gap] + 1]))


def _scan(column: pa.Array, tokens: np.ndarray, key: int = 0):
    """Per chunk: first row, end row, words' hashes and bounds, the distinct (block, token) pairs, and the
    row and the number of words of each block. Only blocks with words are numbered."""
    for a, b, values, offsets in textscan.byte_chunks(column):
        starts, ends, at = textscan.words(values, offsets, "alnum")
        hashes = textscan.lower_hashes(values, starts, ends, key)
        begins = _blocks(values, offsets)
        block = np.searchsorted(begins, starts, "right") - 1
        some, block = np.unique(block, return_inverse=True)
        place = np.minimum(np.searchsorted(tokens, hashes), len(tokens) - 1)
        hit = tokens[place] == hashes
        pairs = np.unique(block[hit] * len(tokens) + place[hit])
        rows = np.searchsorted(offsets, begins[some], "right") - 1
        yield a, b, hashes, at, pairs // len(tokens), pairs % len(tokens), rows, np.bincount(block, minlength=len(some))


def _runs(rows: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First blocks and ends of the longest runs of neighbouring blocks of a row that have at most ``width``
    words between their first and their last block; every other such run is part of one of these."""
    n = len(rows)
    before = np.append(0, np.cumsum(sizes))
    last = np.searchsorted(before[:-1], before[1:] + width, "right")
    ends = np.minimum(last, np.searchsorted(rows, rows, "right"))
    longest = np.append(True, (ends[1:] > ends[:-1]))[:n]
    return np.flatnonzero(longest), ends[longest]


def token_frequencies(docs: DataFrame, text_col: str, tokens: np.ndarray, key: int = 0) -> np.ndarray:
    """In how many text blocks of ``docs`` each template token stands; a row a token comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(tokens), np.int64)
        for batch in batches:
            for *_, token, _, _ in _scan(batch.column("text"), tokens, key):
                total += np.bincount(token, minlength=len(tokens))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["token", "n"])

    out = np.zeros(len(tokens), np.int64)
    for token, n in docs.select(F.col(text_col).alias("text")).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n")).collect():
        out[token] = n
    return out


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT
) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)``, one row per row.

    Base places are the word positions where the words of a phrase stand consecutively. Text blocks are lines
    up to a blank line, and runs of neighbouring such blocks that have no more words between the first and the
    last of them than the template, as notices have blank lines within. A block has a template's label when it
    holds at least ``containment`` of the template's distinct words. All such blocks are found: template tokens
    are ordered by their frequency over all single blocks, and a block is compared with a template only if it
    holds a token of the template's prefix, is long enough, and can still reach the overlap from the place of
    the first common token. Of runs, only those that are part of no other are looked at, as these hold most.
    ``score`` is 1 for a base place, else the best containment that reached the threshold, else 0.

    Null and empty texts have no words, empty labels and score 0. Null and repeated ids and repeated
    rows are kept; other columns are not read; no rows give no rows. The templates are a fixed list.
    """
    bound_batches(docs.sparkSession)
    key = textscan.secret_key()
    tokens, sets = template_sets(templates, key)
    frequency = token_frequencies(docs, text_col, tokens, key)
    order = np.lexsort((tokens, frequency))
    rank = np.empty(len(tokens), np.int64)
    rank[order] = np.arange(len(tokens))
    ordered = [np.sort(rank[s]) for s in sets]
    needs = [max(1, math.ceil(containment * len(s) - 1e-9)) for s in sets]
    prefixes, members = np.zeros((2, len(templates), len(tokens)), bool)
    for k, (s, need) in enumerate(zip(ordered, needs)):
        prefixes[k, s[: len(s) - need + 1]] = True
        members[k, s] = True
    widths = [len(textscan.hash_words(text, "alnum", key)) for _, text in templates]
    labels = [label for label, _ in templates]
    phrases = [(textscan.hash_words(p, "alnum", key), label) for p, label in PHRASES.items()]

    def share_of(held: np.ndarray, k: int) -> float:
        """The share of template ``k`` in a block's distinct ranks, sorted; 0 where that is too little."""
        template, need = ordered[k], needs[k]
        if len(held) < need:
            return 0.0
        place = np.searchsorted(template, held)
        common = template[np.minimum(place, len(template) - 1)] == held
        first = int(common.argmax())
        if min(len(held) - first, len(template) - int(place[first])) < need:
            return 0.0
        n = int(common.sum())
        return n / len(template) if n >= need else 0.0

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, hashes, at, block, token, rows, sizes in _scan(batch.column("text"), tokens, key):
                n = b - a
                found: list[set[str]] = [set() for _ in range(n)]
                base: list[set[str]] = [set() for _ in range(n)]
                score = np.zeros(n)
                n_base, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1, np.int64)
                for words, label in phrases:
                    hit = hashes[: max(0, len(hashes) - len(words) + 1)] == words[0]
                    for k in range(1, len(words)):
                        hit = hit & (hashes[k : k + len(hit)] == words[k])
                    spots = np.flatnonzero(hit)
                    owner = np.searchsorted(at, spots, "right") - 1
                    inside = spots + len(words) <= at[owner + 1] if len(spots) else np.zeros(0, bool)
                    spots, owner = spots[inside], owner[inside]
                    np.add.at(n_base, owner, 1)
                    np.minimum.at(first, owner, spots - at[owner])
                    np.maximum.at(last, owner, spots - at[owner])
                    for r in np.unique(owner).tolist():
                        base[r].add(label)
                ranks = rank[token]
                bounds = np.searchsorted(block, np.arange(len(rows) + 1))
                for k, width in enumerate(widths):
                    begin, end = _runs(rows, sizes, width)
                    x, y = bounds[begin], bounds[end]
                    likely, own = (np.append(0, np.cumsum(of[k][ranks])) for of in (prefixes, members))
                    some = (likely[y] > likely[x]) & (own[y] - own[x] >= needs[k])
                    for r, i, j in zip(rows[begin[some]].tolist(), x[some].tolist(), y[some].tolist()):
                        if share := share_of(np.unique(ranks[i:j]), k):
                            found[r].add(labels[k])
                            score[r] = max(score[r], share)
                none = n_base == 0
                score[~none] = 1.0
                columns = [
                    batch.column("doc_id").slice(a, n),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array(n_base, pa.int64()),
                    pa.array(first, pa.int64(), mask=none),
                    pa.array(last, pa.int64(), mask=none),
                    pa.array([",".join(sorted(x)) for x in base], pa.string()),
                    pa.array([",".join(sorted(x | y)) for x, y in zip(base, found)], pa.string()),
                    pa.array(score, pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def oracle() -> str:
    """All runs of neighbouring blocks against all templates, and all places of the phrases."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    lower = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    templates = ", ".join(f"({k}, {quoted(label)}, {quoted(text)})" for k, (label, text) in enumerate(TEMPLATES))
    phrases = " UNION ALL ".join(
        f"SELECT doc_id, i AS place, {quoted(label)} AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE "
        + " AND ".join(f"w[i + {k}] = {quoted(x)}" for k, x in enumerate(phrase.split()))
        for phrase, label in PHRASES.items()
    )
    return rf"""
WITH d AS (SELECT doc_id, {lower.format("coalesce(text, '')")} AS text, regexp_extract_all({lower.format("coalesce(text, '')")}, {word}) AS w FROM documents),
v AS (SELECT * FROM (VALUES {templates}) AS x(tid, label, text)),
t AS (SELECT tid, label, regexp_extract_all({lower.format("text")}, {word}) AS w FROM v),
z AS (SELECT tid, label, len(w) AS width, len(list_distinct(w)) AS size, unnest(list_distinct(w)) AS token FROM t),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d),
b AS (SELECT doc_id, regexp_extract_all(line, {word}) AS w, sum(CASE WHEN regexp_full_match(line, '[ 	-
]*') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS block FROM l),
g AS (SELECT doc_id, block, sum(len(w)) AS n FROM b GROUP BY ALL HAVING sum(len(w)) > 0),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block) AS i, sum(n) OVER (PARTITION BY doc_id ORDER BY block) AS upto FROM g),
u AS (SELECT DISTINCT doc_id, block, unnest(w) AS token FROM b),
h AS (SELECT u.doc_id, n.i, n.n, n.upto, z.tid, z.label, z.width, z.size, z.token FROM u JOIN z ON z.token = u.token JOIN n ON n.doc_id = u.doc_id AND n.block = u.block),
s AS (SELECT DISTINCT doc_id, tid, i, n, upto, width FROM h),
r AS (SELECT p.doc_id, p.tid, p.i, q.i AS j FROM s p JOIN s q ON p.doc_id = q.doc_id AND p.tid = q.tid AND q.i >= p.i AND (q.i = p.i OR q.upto - q.n - p.upto <= p.width)),
c AS (SELECT r.doc_id, r.tid, r.i, r.j, h.label, h.size, count(DISTINCT h.token) AS c FROM r JOIN h ON h.doc_id = r.doc_id AND h.tid = r.tid AND h.i BETWEEN r.i AND r.j GROUP BY ALL),
m AS (SELECT doc_id, label, max(c / size) AS share FROM c WHERE c >= greatest(1, ceil({CONTAINMENT} * size - 1e-9)) GROUP BY ALL),
p AS ({phrases}),
e AS (SELECT doc_id, count(*) AS n_base, min(place) - 1 AS first_word, max(place) - 1 AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM m UNION SELECT doc_id, label FROM p) GROUP BY doc_id),
o AS (SELECT doc_id, max(share) AS share FROM m GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0) END AS score
FROM d LEFT JOIN e ON e.doc_id = d.doc_id LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN o ON o.doc_id = d.doc_id
"""
