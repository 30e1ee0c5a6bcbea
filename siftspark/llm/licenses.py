"""License scan by template-markup matching.

A template is license wording with marked regions: `[[...]]` may be left out, `{{n}}` stands for up to n words of
anything (holder, year, name). It is compiled into an automaton over words; a text is accepted where all mandatory
wording stands in order, exactly, with nothing between but what the regions allow. The short license texts (MIT, ISC,
BSD) are whole, warranty part included; of the long ones (Apache, GPL) the notices that they ask for are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases that a license is named by, and the labels they give.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label, template. Public license wording.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license [[,]] version 2.0"),
    ("gpl-3.0", "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 3"),
    ("gpl-2.0", "licensed under the [[terms of the]] gnu general public license [[as published by the free software foundation]] [[either]] version 2"),
    ("mit-notice", "[[this {{4}} is]] released under the [[terms of the]] mit license"),
    ("mit-notice", "licensed under the [[terms of the]] mit license"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[the]] [[creative commons]] cc by nc 4.0"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[the]] creative commons attribution noncommercial 4.0 [[international]] [[license]]"),
    ("cc-by-4.0", "licensed under [[a]] [[the]] [[creative commons]] cc by 4.0"),
    ("cc-by-sa-4.0", "licensed under [[a]] [[the]] [[creative commons]] cc by sa 4.0"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    (
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall {{8}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    (
        "isc-text",
        "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and {{6}} all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{6}} be liable for any special direct indirect or consequential damages "
        "or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    (
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions "
        "and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "[[[[3]] neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission]] "
        "this software is provided by {{10}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall {{10}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
        "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    (
        "apache-2.0-notice",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at [[http]] [[https]] www.apache.org/licenses/license-2.0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "gpl-3.0-notice",
        "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version "
        "[[this]] {{4}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details "
        "you should have received a copy of the gnu general public license along with {{4}} if not see [[http]] [[https]] www.gnu.org/licenses",
    ),
)

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARK = re.compile(r"\[\[|\]\]|\{\{(\d+)\}\}|[^\s\[\]{}]+")


def words_of(text: str) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "replace").lower())


@dataclass(frozen=True)
class Automaton:
    """States are places in the wording. words[s]: mandatory word and next state; skips[s]: free moves; loops[s]: words a region takes at most."""

    label: str
    words: dict[int, bytes]
    skips: dict[int, tuple[int, ...]]
    loops: dict[int, int]
    end: int
    mandatory: int
    first: frozenset[bytes]
    required: tuple[bytes, ...]


def compile_template(label: str, template: str) -> Automaton:
    words: dict[int, bytes] = {}
    skips: dict[int, list[int]] = {}
    loops: dict[int, int] = {}
    opened: list[int] = []
    state, needed = 0, []
    for m in _MARK.finditer(template):
        mark = m.group(0)
        if mark == "[[":
            opened.append(state)
            skips.setdefault(state, []).append(state + 1)
            state += 1
        elif mark == "]]":
            skips.setdefault(opened.pop(), []).append(state)
        elif m.group(1):
            loops[state] = int(m.group(1))
            skips.setdefault(state, []).append(state + 1)
            state += 1
        else:
            for w in words_of(mark):
                words[state] = w
                state += 1
                if not opened:
                    needed.append(w)
    if opened or not needed:
        raise ValueError(f"template of {label} has an open region or no mandatory word")
    free = {s: tuple(t) for s, t in skips.items()}
    start = _closure({(0, 0)}, free)
    if any(s in loops for s, _ in start):
        raise ValueError(f"template of {label} starts with a replaceable region")
    return Automaton(label, words, free, loops, state, len(needed), frozenset(words[s] for s, _ in start if s in words), tuple(dict.fromkeys(needed)))


def _closure(states: set[tuple[int, int]], skips: dict[int, tuple[int, ...]]) -> set[tuple[int, int]]:
    todo, seen = list(states), set(states)
    while todo:
        s, _ = todo.pop()
        for t in skips.get(s, ()):
            if (t, 0) not in seen:
                seen.add((t, 0))
                todo.append((t, 0))
    return seen


def accept(a: Automaton, words: list[bytes], at: int) -> int:
    """The end of the longest match that starts at word `at`, or -1."""
    now, best = _closure({(0, 0)}, a.skips), -1
    for i in range(at, len(words)):
        moved = set()
        for s, taken in now:
            if a.words.get(s) == words[i]:
                moved.add((s + 1, 0))
            if taken < a.loops.get(s, 0):
                moved.add((s, taken + 1))
        if not moved:
            return best
        now = _closure(moved, a.skips)
        if any(s == a.end for s, _ in now):
            best = i + 1
    return best


def find(automata: list[Automaton], words: list[bytes]) -> list[tuple[str, int, int, int]]:
    """(label, first word, end, mandatory words) of every place that an automaton accepts."""
    there = set(words)
    live = [a for a in automata if there.issuperset(a.required)]
    by_first: dict[bytes, list[Automaton]] = {}
    for a in live:
        for w in a.first:
            by_first.setdefault(w, []).append(a)
    return [(a.label, i, end, a.mandatory) for i, w in enumerate(words) if w in by_first for a in by_first[w] if (end := accept(a, words, i)) > 0]


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """One row per document: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    spans: array of (label, first_word, end_word) that templates accept. score: the largest share of mandatory words in
    an accepted span, 0.5 where only a phrase stands, else 0. A null text counts as empty: no words, empty labels. A text
    of any length is taken whole. Repeated rows give repeated results, null ids are passed on, an empty table gives none;
    other columns don't matter. One scan, without a shuffle.
    """
    automata = [compile_template(*t) for t in templates]
    named = [(p.encode().split(b" "), label) for p, label in phrases.items()]
    # a text without any of these can match nothing: the rarest-looking word of each template and phrase
    hints = sorted({max(p, key=len) for p, _ in named} | {max(a.required, key=len) for a in automata})
    hint = re.compile(b"|".join(map(re.escape, hints)))
    id_type = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        inside = np.ones(256, bool)
        inside[0x00:0x30] = inside[0x3A:0x41] = inside[0x5B:0x61] = inside[0x7B:0x80] = False
        for batch in batches:
            out = []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode("utf-8", "replace").lower()
                if not hint.search(raw):
                    m = inside[np.frombuffer(raw, np.uint8)]
                    n = int(np.count_nonzero(m[1:] & ~m[:-1]) + m[0]) if len(m) else 0
                    out.append((n, 0, None, None, "", "", 0.0, []))
                    continue
                words = _WORD.findall(raw)
                starts, base = [], set()
                for p, label in named:
                    at = [i for i, w in enumerate(words) if w == p[0] and words[i : i + len(p)] == p]
                    starts += at
                    base |= {label} if at else set()
                spans = find(automata, words)
                score = max([0.5 * bool(base), *(k / (end - i) for _, i, end, k in spans if end > i)])
                labels = sorted(base | {s[0] for s in spans})
                out.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(labels), min(1.0, score), [s[:3] for s in spans]))
            columns = list(zip(*out, strict=True)) if out else [[]] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            spans = pa.array([[{"label": a, "first_word": b, "end_word": c} for a, b, c in s] for s in columns[7]], pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns[:7], kinds, strict=True)), spans], ["_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    schema = f"_id {id_type}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label string, first_word long, end_word long>>"
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).mapInArrow(scan, schema).withColumnRenamed("_id", id_col)
