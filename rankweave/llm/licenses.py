"""Licence scans: normalised stretches of text against templates by the Dice coefficient of word bigrams.

Units of a text are its lines and its blocks of consecutive non-blank lines. A unit is normalised to its
ASCII words in lower case; its set of adjacent word pairs is compared with each template's by
``2 |A & B| / (|A| + |B|)``. Since the intersection is at most the smaller set, a template of b pairs can
reach the threshold t only for units of ``b t / (2 - t)`` to ``b (2 - t) / t`` pairs; units outside every
template's bounds are dropped before any pair is formed, the others meet only templates that admit them
and share a pair with them (inverted table). Templates are a fixed small set, so each text is judged
where it lies: no shuffle, no join.

`license_stretches` finds notices that are neither a line nor a block: it compares each template, and the
longer texts of ``license_texts``, with stretches of words anywhere in the text, across lines and comment
marks (which are no words); long licences are known section by section. A template of b pairs needs ``b t / (2 - t)``
of them, so its rarest pairs tell whether a text can hold it at all; other templates are not looked at. A stretch begins and ends with a pair of the template, since other pairs at
its ends only lower Dice, and has at most ``(2 - t) / t`` times as many word pairs as the template.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from rankweave.llm.license_texts import FULL_TEXTS, body_templates
from rankweave.llm.scratch import small_batches

# Notices by which works name their licence, and the operative sentences of short licences.
TEMPLATES: dict[str, str] = {
    "AGPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License.",
    "Apache-2.0": "Licensed under the Apache License 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-short": "Apache License, Version 2.0",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "BSD-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY": "Licensed under CC BY 4.0.",
    "CC-BY-NC": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA": "Licensed under CC BY-SA 4.0.",
    "CC0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL": "This work is licensed under the GNU General Public License.",
    "GPL-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL": "This work is licensed under the GNU Lesser General Public License.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Reserved": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: The threshold in per cent: compared in integers, so that ties at the threshold count.
THRESHOLD = 80

_WORD = re.compile(r"[A-Za-z0-9]+")


def bigrams(unit: str) -> set[tuple[str, str]]:
    words = [w.lower() for w in _WORD.findall(unit)]
    return set(zip(words, words[1:], strict=False))


def units(text: str) -> list[str]:
    """Lines, and blocks of two or more consecutive lines that are not blank."""
    out, block = [], []
    for line in [*text.split("\n"), ""]:
        if line.strip(" \t\r\x0b\x0c"):
            block.append(line)
        else:
            out += block
            if len(block) > 1:
                out.append(" ".join(block))
            block = []
    return out


class Scanner:
    """Templates prepared for scanning."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, threshold: int = THRESHOLD):
        self.sets = {name: bigrams(text) for name, text in templates.items()}
        self.threshold = threshold
        self.bounds = {n: (-(-len(s) * threshold // (200 - threshold)), len(s) * (200 - threshold) // threshold) for n, s in self.sets.items()}
        self.lowest = min((lo for lo, _ in self.bounds.values()), default=1)
        self.highest = max((hi for _, hi in self.bounds.values()), default=0)
        self.holders: dict[tuple[str, str], list[str]] = {}
        for name, pairs in self.sets.items():
            for p in pairs:
                self.holders.setdefault(p, []).append(name)

    def scan(self, text: str) -> list[tuple[str, float]]:
        """(template, Dice) of every unit and template that reach the threshold."""
        out = []
        for unit in units(text):
            if len(unit) < 2 * self.lowest or sum(1 for _ in _WORD.finditer(unit)) < self.lowest + 1:
                continue
            pairs = bigrams(unit)
            n = len(pairs)
            if not self.lowest <= n <= self.highest:
                continue
            shared: dict[str, int] = {}
            for p in pairs:
                for name in self.holders.get(p, ()):
                    shared[name] = shared.get(name, 0) + 1
            for name, k in shared.items():
                lo, hi = self.bounds[name]
                if lo <= n <= hi and 200 * k >= self.threshold * (n + len(self.sets[name])):
                    out.append((name, 2 * k / (n + len(self.sets[name]))))
        return out


class StretchScanner(Scanner):
    """Templates prepared for stretches of words anywhere in a text."""

    def __init__(self, templates: dict[str, str], threshold: int = THRESHOLD):
        super().__init__(templates, threshold)
        #: word pairs of the longest stretch; a template may hold a pair more than once
        self.reach = {n: (len(_WORD.findall(t)) - 1) * (200 - threshold) // threshold for n, t in templates.items()}
        #: of the need + (pairs that may be missing) rarest pairs of a template, a text must hold need
        self.need, self.anchors = {}, {}
        for name, pairs in self.sets.items():
            least = self.bounds[name][0]
            self.need[name] = max(1, least // 3)
            for p in sorted(pairs, key=lambda p: (len(self.holders[p]), p))[: len(pairs) - least + self.need[name]]:
                self.anchors.setdefault(p, []).append(name)

    def _candidates(self, pairs: list[tuple[str, str]]) -> list[str]:
        held: dict[str, int] = {}
        for p in self.anchors.keys() & set(pairs):
            for name in self.anchors[p]:
                held[name] = held.get(name, 0) + 1
        return sorted(name for name, k in held.items() if k >= self.need[name])

    def _starts(self, name: str, at: list[int], pairs: list[tuple[str, str]]) -> Iterator[int]:
        """Positions in at from which enough distinct pairs of the template lie within reach."""
        need, reach = self.bounds[name][0], self.reach[name]
        held: dict[tuple[str, str], int] = {}
        end = 0
        for i in at:
            while end < len(at) and at[end] < i + reach:
                held[pairs[at[end]]] = held.get(pairs[at[end]], 0) + 1
                end += 1
            if len(held) >= need:
                yield i
            held[pairs[i]] -= 1
            if not held[pairs[i]]:
                del held[pairs[i]]

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, Dice, start, end) of the stretches that reach the threshold, in characters; those of
        one template do not overlap (the best, then the first, is taken first)."""
        words = [w.lower() for w in _WORD.findall(text)]
        pairs = list(zip(words, words[1:], strict=False))
        candidates = self._candidates(pairs)
        if not candidates:
            return []
        at = {name: [i for i, p in enumerate(pairs) if p in self.sets[name]] for name in candidates}
        taken = []
        for name, places in at.items():
            (lo, hi), own, reach = self.bounds[name], self.sets[name], self.reach[name]
            if len(places) < lo:
                continue
            found = []
            for i in self._starts(name, places, pairs):
                seen: set[tuple[str, str]] = set()
                k, best = 0, None
                for j in range(i, min(i + reach, len(pairs))):
                    p = pairs[j]
                    if p in seen:
                        continue
                    seen.add(p)
                    if len(seen) > hi:
                        break
                    if p in own:
                        k += 1
                        if 200 * k >= self.threshold * (len(seen) + len(own)):
                            dice = 2 * k / (len(seen) + len(own))
                            if best is None or dice > best[0]:
                                best = (dice, i, j)
                if best:
                    found.append(best)
            used: list[tuple[int, int]] = []
            for dice, i, j in sorted(found, key=lambda m: (-m[0], m[2] - m[1], m[1])):
                near = bisect(used, (j + 2, -1))  # stretches are apart: only the last that starts up to word j + 1 can overlap
                if not near or used[near - 1][1] + 1 < i:
                    used.insert(near, (i, j))
                    taken.append((name, dice, i, j + 1))
        if not taken:
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        return [(name, dice, spans[i][0], spans[j][1]) for name, dice, i, j in taken]


def license_stretches(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """``(id_col, n_stretches, license, dice, stretches)`` per row of docs.

    ``stretches`` holds ``(license, dice, start, end)`` in characters, by start, end and name; ``license``
    is the best one (highest Dice, then the longest, then by name). Rows are handled as in `license_scan`.
    """
    small_batches(docs.sparkSession)
    chosen = TEMPLATES | FULL_TEXTS | body_templates() if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = StretchScanner(chosen, threshold)
        kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [sorted(scanner.scan(t or ""), key=lambda m: (m[2], m[3], m[0])) for t in part.column(1).to_pylist()]
                best = [min(f, key=lambda m: (-m[1], m[2] - m[3], m[0])) if f else (None, None) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(f) for f in found], pa.int64()),
                        pa.array([b[0] for b in best], pa.string()),
                        pa.array([b[1] for b in best], pa.float64()),
                        pa.array([[dict(zip(("license", "dice", "start", "end"), m, strict=True)) for m in f] for f in found], kind),
                    ],
                    names=["id", "n_stretches", "license", "dice", "stretches"],
                )

    out = f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_stretches long, license string, dice double, stretches array<struct<license:string,dice:double,start:int,end:int>>"
    return docs.select(id_col, text_col).mapInArrow(run, out)


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: int = THRESHOLD) -> DataFrame:
    """``(id_col, n_matches, license, dice, licenses)`` per row of docs.

    ``n_matches`` counts (unit, template) pairs at or above the threshold, ``license`` is the best one
    (highest Dice, ties by name), ``licenses`` all names in order. Null, empty or plain texts have no
    match: 0, null, null, []; very long ones are scanned whole. Rows are handled one by one, so null or repeated
    ids keep their rows and equal texts get equal values; an empty table gives an empty result; other columns
    are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    chosen = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, threshold)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [scanner.scan(t or "") for t in part.column(1).to_pylist()]
                best = [min(f, key=lambda m: (-m[1], m[0])) if f else (None, None) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([len(f) for f in found], pa.int64()),
                        pa.array([b[0] for b in best], pa.string()),
                        pa.array([b[1] for b in best], pa.float64()),
                        pa.array([sorted({m[0] for m in f}) for f in found], pa.list_(pa.string())),
                    ],
                    names=["id", "n_matches", "license", "dice", "licenses"],
                )

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, n_matches long, license string, dice double, licenses array<string>")


def license_sql() -> str:
    """The digest ``(doc_id, n_matches, license, dice)`` as DuckDB SQL over ``documents``."""
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES.items())
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH t AS (SELECT name, {grams} AS g FROM (SELECT name, list_transform(regexp_extract_all(txt, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM (VALUES {values}) AS v(name, txt))),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
full_lines AS (SELECT *, regexp_matches(line, '[^ \\t\\r\\x0B\\x0C]') AS filled FROM lines),
blocks AS (SELECT *, sum(CASE WHEN filled THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY k) AS block FROM full_lines),
units AS (SELECT doc_id, line AS unit FROM blocks WHERE filled UNION ALL
  SELECT doc_id, string_agg(line, ' ' ORDER BY k) FROM blocks WHERE filled GROUP BY doc_id, block HAVING count(*) > 1),
grams AS (SELECT doc_id, {grams} AS g FROM (SELECT doc_id, list_transform(regexp_extract_all(unit, '[A-Za-z0-9]+'), lambda x: lower(x)) AS w FROM units)),
hits AS (SELECT doc_id, name, 2.0::DOUBLE * len(list_intersect(grams.g, t.g)) / (len(grams.g) + len(t.g)) AS dice FROM grams JOIN t
  ON len(grams.g) BETWEEN floor(len(t.g) * {THRESHOLD} / {200 - THRESHOLD}.0) AND ceil(len(t.g) * {200 - THRESHOLD} / {THRESHOLD}.0)),
good AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, name) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM hits WHERE dice >= {THRESHOLD} / 100.0)
SELECT d.doc_id, coalesce(g.n, 0)::BIGINT AS n_matches, g.name AS license, g.dice FROM documents d LEFT JOIN good g ON g.doc_id = d.doc_id AND g.r = 1
"""
