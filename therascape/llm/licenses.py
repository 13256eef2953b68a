"""License scans: windows of words against licence templates by the Dice coefficient over word bigrams (operator 9).

A template and a text are normalised alike: A-Z folded, words of letters, digits and dots, bigrams as a
multiset; lines do not matter, so a notice may stand inside a line or wrap over many.  Dice = 2 * shared / (bigrams of
both) can reach the threshold t only if a window has between t / (2 - t) and (2 - t) / t times the template's bigrams, of
which at least t / (2 - t) times as many are shared: a template is passed over where the whole text, or every window from
a place on, shares fewer.  A best window begins and ends with a bigram of the template, so only those are compared.

A window that begins d words later shares no more bigrams than one with the same end, so its coefficient is at most
1 + d / (the least sum of bigrams) times as large: of a run of begins the first one bounds all others.  Runs wait in the order of
their bounds and are looked into only when nothing better is left, so copies of a licence in a row cost one look a run, not a begin.
Very long texts are scanned whole.

Defined results: null text has no words; of windows that share words the most alike is reported, ties by the larger
template, the earlier place and the name; repeated rows are reported alike; an empty table gives an empty table;
templates are a parameter of a few dozen entries, those of one word never match.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from importlib import resources
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from therascape.llm.common import table

#: Short notices of common licences by SPDX identifier.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-title": "The MIT License (MIT)",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
#: Whole licence texts, by their file's name and "-text".
TEMPLATES = NOTICES | {f.name.removesuffix(".txt") + "-text": f.read_text("utf-8") for f in sorted(resources.files("therascape.llm.license_texts").iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}
THRESHOLD = 0.8
#: A run of begins is as long as the template over this.
RUNS = 64
_WORD = re.compile(rb"[a-z0-9.\x80-\xff]*[a-z0-9\x80-\xff]")


def bigrams(line: bytes) -> Counter:
    words = _WORD.findall(line.lower())
    return Counter(zip(words, words[1:]))


class Marks:
    """The bigrams of a text that one template has, and the best windows over them."""

    def __init__(self, at: np.ndarray, pair: np.ndarray, count: np.ndarray, n: int, threshold: float):
        """``at`` and ``pair``: places and numbers of the bigrams; ``count``: how often the template, of n bigrams, has each number."""
        self.at, self.n, self.threshold = at, n, threshold
        order = np.argsort(pair, kind="stable")
        group, k = pair[order], np.arange(len(at))
        before = k - count[group]
        same = (before >= 0) & (group[before] == group)
        #: A bigram counts in a window only if the window begins after this mark: the template has it no more often.
        self.full = np.empty(len(at), np.int64)
        self.full[order] = np.where(same, order[before], -1)
        self.reach = np.searchsorted(at, at + int(n * (2 - threshold) / threshold + 1e-9))
        self.starts = np.flatnonzero(self.reach - k >= n * threshold / (2 - threshold) - 1e-9)

    def runs(self) -> Iterator[tuple[float, np.ndarray]]:
        """(bound, begins): begins that lie close together and what no window of theirs exceeds; only those that reach the threshold."""
        begins = self.at[self.starts]
        for run in np.split(self.starts, np.flatnonzero(np.diff(begins // max(1, self.n // RUNS))) + 1):
            if len(run) < 2:
                bound = 1.0
            else:
                i, end = int(run[0]), int(self.reach[run[-1]])
                most = (2 * np.cumsum(self.full[i:end] < i) / (self.at[i:end] - self.at[i] + 1 + self.n)).max()
                later = self.at[run[-1]] - self.at[i]
                bound = min(1.0, float(most * (1 + later * (2 - self.threshold) / (2 * self.n))) + 1e-9)
            if len(run) and bound >= self.threshold:
                yield bound, run

    def best(self, i: int, stop: int) -> tuple[float, int] | None:
        """(Dice, word after the end) of the most alike window that begins at mark i and ends before the word ``stop``."""
        end = min(int(self.reach[i]), int(np.searchsorted(self.at, stop - 1)))
        if end <= i:
            return None
        shared = np.cumsum(self.full[i:end] < i)
        dice = 2 * shared / (self.at[i:end] - self.at[i] + 1 + self.n)
        k = int(np.argmax(dice))
        return (float(dice[k]), int(self.at[i + k]) + 2) if dice[k] >= self.threshold else None


class Templates:
    def __init__(self, texts: dict[str, str], threshold: float):
        self.threshold = threshold
        of = [(k, b) for k, b in ((k, bigrams(v.encode())) for k, v in sorted(texts.items())) if b]
        self.names, self.sizes = [k for k, _ in of], [b.total() for _, b in of]
        self.words = {w: k for k, w in enumerate(sorted({w for _, b in of for p in b for w in p}))}
        code = lambda p: self.words[p[0]] * len(self.words) + self.words[p[1]]
        self.pairs = np.array(sorted({code(p) for _, b in of for p in b}), np.int64)
        self.of = [(np.searchsorted(self.pairs, [code(p) for p in b]), np.array(list(b.values()))) for _, b in of]
        if of:
            self.all_pairs, self.all_counts = (np.concatenate(x) for x in zip(*self.of, strict=True))
            self.first = np.cumsum([0, *[len(p) for p, _ in self.of[:-1]]])
            self.need = np.array(self.sizes) * threshold / (2 - threshold) - 1e-9

    def marks(self, words: list[bytes]) -> dict[int, Marks]:
        """Of every template that the text may hold, by number, its bigrams in the text."""
        if not self.of or len(words) < 2:
            return {}
        ids = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
        code = ids[at] * len(self.words) + ids[at + 1]
        pair = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        known = self.pairs[pair] == code
        at, pair = at[known], pair[known]
        if len(at) < self.need.min():
            return {}
        have = np.bincount(pair, minlength=len(self.pairs))
        shared = np.add.reduceat(np.minimum(have[self.all_pairs], self.all_counts), self.first)
        out = {}
        for t in np.flatnonzero(shared >= self.need).tolist():
            count = np.zeros(len(self.pairs), np.int64)
            count[self.of[t][0]] = self.of[t][1]
            held = count[pair] > 0
            out[t] = Marks(at[held], pair[held], count, self.sizes[t], self.threshold)
        return out

    def scan(self, text: bytes) -> list[dict]:
        """Matching windows: first line, lines, template and Dice coefficient; the best of those that share words."""
        low = text.lower()
        words = _WORD.findall(low)
        marks, heap = self.marks(words), []

        def put(t: int, i: int, stop: int) -> None:
            if hit := marks[t].best(i, stop):
                heapq.heappush(heap, (-hit[0], -self.sizes[t], int(marks[t].at[i]), self.names[t], hit[1], t, i))

        for t, m in marks.items():
            for bound, run in m.runs():
                if len(run) == 1:
                    put(t, int(run[0]), len(words))
                else:
                    heapq.heappush(heap, (-bound, -self.sizes[t], int(m.at[run[0]]), self.names[t], 0, t, run))
        begins, ends, found = [], [], []
        while heap:
            dice, _, begin, name, end, t, i = heapq.heappop(heap)
            k = bisect(begins, begin)
            if not end:  # a run: its begins outside the windows found wait by themselves
                if not k or ends[k - 1] <= marks[t].at[i[-1]]:
                    for j in i.tolist():
                        k = bisect(begins, marks[t].at[j])
                        if not k or ends[k - 1] <= marks[t].at[j]:
                            put(t, j, begins[k] if k < len(begins) else len(words))
                continue
            if k and ends[k - 1] > begin:
                continue
            if k < len(begins) and begins[k] < end:
                put(t, i, begins[k])
                continue
            begins.insert(k, begin)
            ends.insert(k, end)
            found.insert(k, (name, -dice))
        if not found:
            return []
        places = [m.start() for m in _WORD.finditer(low)]
        breaks = np.flatnonzero(np.frombuffer(low, np.uint8) == 10)
        line = lambda word: int(np.searchsorted(breaks, places[word]))
        return [{"line": line(a), "lines": line(b - 1) - line(a) + 1, "license": name, "dice": dice} for a, b, (name, dice) in zip(begins, ends, found, strict=True)]


def scanned(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """(row, matches) for every input row; ``row`` is the input row without its text."""
    known = Templates(TEMPLATES if templates is None else templates, threshold)
    match = pa.list_(pa.struct([("line", pa.int64()), ("lines", pa.int64()), ("license", pa.string()), ("dice", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x in batch.column("text"):
                text = x.as_py()
                found.append(known.scan(text) if text else [])
            yield pa.record_batch({"row": batch.column("row"), "matches": pa.array(found, match)})

    src = docs.select(F.struct(*[docs[c] for c in docs.columns if c != text_col]).alias("row"), F.col(text_col).cast("binary").alias("text"))
    kind = T.ArrayType(T.StructType().add("line", "long").add("lines", "long").add("license", "string").add("dice", "double"))
    return src.mapInArrow(run, T.StructType([src.schema["row"], T.StructField("matches", kind)]))


def op9_license_scan(spark, sf_dir):
    """Every document of ``documents``: its licences and the best coefficient."""
    out = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = F.array_join(F.array_sort(F.array_distinct("matches.license")), ",")
    return out.select(F.col("row.doc_id").alias("doc_id"), F.size("matches").cast("long").alias("n_matches"), names.alias("licenses"), F.coalesce(F.array_max("matches.dice"), F.lit(0.0)).alias("best_dice"))
