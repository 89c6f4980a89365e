"""Licence scan by template markup: templates with optional and replaceable regions become token automata.

A template is plain wording with `<<beginOptional>>...<<endOptional>>` around words that may be missing and
`<<var;max=N>>` where up to N words of any kind may stand. Its automaton accepts a text that holds, somewhere, the
mandatory wording word for word, in order, with nothing else between.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracelens.llm.common import in_chunks

#: Phrases and the labels that a place of them gives.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Public licence notices and texts, as templates.
TEMPLATES = {
    "apache-2.0": "licensed under the <<beginOptional>>terms of the<<endOptional>> apache license <<beginOptional>>version<<endOptional>> 2.0",
    "apache-2.0-header": (
        "licensed under the apache license version 2.0 <<beginOptional>>the license<<endOptional>> you may not use this file except in compliance with the license"
        " you may obtain a copy of the license at <<var;max=8>> unless required by applicable law or agreed to in writing software distributed under the license"
        " is distributed on an as is basis without warranties or conditions of any kind either express or implied"
    ),
    "cc-by-nc-4.0": "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by nc 4.0",
    "cc-by-4.0": "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by 4.0",
    "cc-by-sa-4.0": "licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>creative commons<<endOptional>> cc by sa 4.0",
    "cc-by-named-4.0": "licensed under <<beginOptional>>the<<endOptional>> <<beginOptional>>a<<endOptional>> creative commons attribution 4.0 international license",
    "gpl-3.0": "under the <<beginOptional>>terms of the<<endOptional>> gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3",
    "gpl-2.0": "under the <<beginOptional>>terms of the<<endOptional>> gnu general public license <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 2",
    "lgpl": "under the <<beginOptional>>terms of the<<endOptional>> gnu lesser general public license <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version <<var;max=2>> of the license or <<beginOptional>>at your option<<endOptional>> any later version",
    "mit-notice": "<<beginOptional>>is<<endOptional>> released under the <<beginOptional>>terms of the<<endOptional>> mit license",
    "mit-licensed": "licensed under the <<beginOptional>>terms of the<<endOptional>> mit license",
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
        " the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish"
        " distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject"
        " to the following conditions the above copyright notice and this permission notice"
        " <<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial portions of the software"
    ),
    "isc-text": (
        "permission to use copy modify and <<beginOptional>>or<<endOptional>> distribute this software for any purpose with or without fee is hereby"
        " granted provided that the above copyright notice and this permission notice appear in all copies"
    ),
    "bsd-text": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
        " <<var;max=2>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
    ),
    "agpl-3.0": "under the <<beginOptional>>terms of the<<endOptional>> gnu affero general public license <<beginOptional>>as published by the free software foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version 3",
    "apache-2.0-text": "apache license version 2.0 january 2004 <<var;max=5>> terms and conditions for use reproduction and distribution",
    "gpl-3.0-text": "gnu general public license version 3 29 june 2007 <<var;max=16>> everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "gpl-2.0-text": "gnu general public license version 2 june 1991 <<var;max=24>> everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "lgpl-3.0-text": "gnu lesser general public license version 3 29 june 2007 <<var;max=16>> everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "lgpl-2.1-text": "gnu lesser general public license version 2.1 february 1999 <<var;max=24>> everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "agpl-3.0-text": "gnu affero general public license version 3 19 november 2007 <<var;max=16>> everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    "mpl-2.0-text": "mozilla public license version 2.0 <<var;max=4>> definitions",
    "unlicense-text": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
    "gpl-3.0-name": "gnu gpl <<beginOptional>>version<<endOptional>> <<beginOptional>>v<<endOptional>> 3",
    "gpl-3.0-short": "gnu gpl v3",
    "gpl-2.0-name": "gnu gpl <<beginOptional>>version<<endOptional>> <<beginOptional>>v<<endOptional>> 2",
    "gpl-2.0-short": "gnu gpl v2",
    "bsd-2-clause-notice": "under the <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>simplified<<endOptional>> bsd 2 clause license",
    "bsd-3-clause-notice": "under the <<beginOptional>>terms of the<<endOptional>> <<beginOptional>>new<<endOptional>> bsd 3 clause license",
    "bsd-notice": "under the <<beginOptional>>terms of the<<endOptional>> bsd license",
    "isc-notice": "under the <<beginOptional>>terms of the<<endOptional>> isc license",
    "cc-by-sa-named-4.0": "creative commons attribution sharealike 4.0 <<beginOptional>>international<<endOptional>> <<beginOptional>>public<<endOptional>> license",
    "cc-by-nc-named-4.0": "creative commons attribution noncommercial 4.0 <<beginOptional>>international<<endOptional>> <<beginOptional>>public<<endOptional>> license",
    "cc-by-nc-sa-named-4.0": "creative commons attribution noncommercial sharealike 4.0 <<beginOptional>>international<<endOptional>> <<beginOptional>>public<<endOptional>> license",
    "cc-by-nd-named-4.0": "creative commons attribution noderivatives 4.0 <<beginOptional>>international<<endOptional>> <<beginOptional>>public<<endOptional>> license",
    "cc0-1.0-notice": "creative commons <<beginOptional>>cc0<<endOptional>> <<beginOptional>>zero<<endOptional>> 1.0 universal <<var;max=3>> public domain dedication",
    **{f"spdx-{name}": f"spdx license identifier {name.replace('-', ' ')}" for name in ("mit", "apache-2.0", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0", "mpl-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "unlicense", "cc0-1.0", "cc-by-4.0", "cc-by-sa-4.0")},
    "mpl-2.0": "subject to the terms of the mozilla public license v 2.0 <<var;max=12>> if a copy of the mpl was not distributed with this file",
}

#: A text with none of these holds no part of a template.
CUES = (b"license", b"licence", b"permission", b"redistribution", b"gpl", b"unencumbered", b"commons")
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MARK = re.compile(r"<<(beginOptional|endOptional|var;max=(\d+))>>")

_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[:0x30] = _IN_WORD[0x3A:0x61] = _IN_WORD[0x7B:0x80] = False


@dataclass
class Automaton:
    """States are numbers; `next` maps a state and a word to states, `any` a state to states on any word."""

    label: str
    next: list[dict[bytes, list[int]]] = field(default_factory=list)
    any: list[list[int]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    mandatory: list[int] = field(default_factory=list)
    start: frozenset[int] = frozenset()
    final: int = 0

    def _state(self, done: int) -> int:
        self.next.append({})
        self.any.append([])
        self.free.append([])
        self.mandatory.append(done)
        return len(self.next) - 1

    def closed(self, states: set[int]) -> frozenset[int]:
        todo, out = list(states), set(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in out:
                    out.add(s)
                    todo.append(s)
        return frozenset(out)

    def step(self, states: frozenset[int], word: bytes) -> frozenset[int]:
        to = {t for s in states for t in (*self.next[s].get(word, ()), *self.any[s])}
        return self.closed(to) if to else frozenset()


def compile_template(label: str, template: str) -> Automaton:
    """One state after each word; an optional region can be stepped over, a replaceable one is a chain that can be left anywhere."""
    made = Automaton(label)
    at, opened, done = made._state(0), [], 0
    pieces, end = [], 0
    for m in MARK.finditer(template):
        pieces += [("word", w) for w in WORD.findall(template[end : m.start()].lower().encode())] + [(m[1].split(";")[0], m[2])]
        end = m.end()
    pieces += [("word", w) for w in WORD.findall(template[end:].lower().encode())]
    for kind, value in pieces:
        if kind == "word":
            done += not opened
            new = made._state(done)
            made.next[at].setdefault(value, []).append(new)
            at = new
        elif kind == "beginOptional":
            opened.append(at)
        elif kind == "endOptional":
            new = made._state(done)
            made.free[at].append(new)
            made.free[opened.pop()].append(new)
            at = new
        else:
            chain = [at]
            for _ in range(int(value)):
                new = made._state(done)
                made.any[chain[-1]].append(new)
                chain.append(new)
            at = made._state(done)
            for s in chain:
                made.free[s].append(at)
    if opened or not done:
        raise ValueError(f"{label}: an optional region isn't closed, or no word is mandatory")
    made.final, made.start = at, made.closed({0})
    return made


def run_automaton(made: Automaton, words: list[bytes]) -> tuple[list[tuple[int, int]], float]:
    """The accepted places (first word, word after the last), and the largest share of the mandatory wording reached.

    All starts move together, so a text is read once; of the starts that share a state the latest counts.
    """
    places, best, total = [], 0, made.mandatory[made.final]
    live: dict[int, int] = {}
    openers = {w for s in made.start for w in made.next[s]}
    for i, word in enumerate(words):
        moved: dict[int, int] = {}
        for s, start in live.items():
            for t in (*made.next[s].get(word, ()), *made.any[s]):
                for u in made.closed({t}):
                    moved[u] = max(moved.get(u, -1), start)
        if word in openers:
            for u in made.step(made.start, word):
                moved[u] = max(moved.get(u, -1), i)
        live = moved
        if live:
            best = max(best, max(made.mandatory[s] for s in live))
            if made.final in live:
                places.append((live[made.final], i + 1))
    return places, best / total


def scan_text(text: bytes, automata: list[Automaton]) -> tuple[list[int], set[str], list[tuple[str, int, int]], float]:
    """(starts of base phrases, base labels, accepted places, score) of a lower-cased text."""
    if not any(cue in text for cue in CUES):
        return [], set(), [], 0.0
    words = WORD.findall(text)
    starts, labels = [], set()
    for phrase, label in BASE_PHRASES.items():
        want = phrase.encode().split()
        if want[0] in text:
            found = [i for i, w in enumerate(words) if w == want[0] and words[i : i + len(want)] == want]
            starts += found
            labels |= {label} if found else set()
    places, score = [], 0.5 if starts else 0.0
    for a in automata:
        got, share = run_automaton(a, words)
        places += [(a.label, s, e) for s, e in got]
        score = max(score, share)
    return starts, labels, sorted(places), score


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<label:string,start:long,end:long>>"


def scan_documents(docs: DataFrame, templates: dict[str, str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: word count, base phrases, labels, score and the accepted places (`matches`).

    score: the largest share of a template's mandatory wording found (1: accepted), at least 0.5 with a base phrase; 0
    for a text that holds none of the words that licences go by. Null text counts as empty: no words, no labels, score 0.
    Very long texts are scanned whole, each template once. Rows are scanned one by one, so ties and repeats don't matter;
    an empty table gives no rows; other columns are not read.
    """
    automata = [compile_template(k, v) for k, v in (templates or TEMPLATES).items()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in in_chunks(batch, "text"):
                data = _TO_LOWER[data]
                inside = _IN_WORD[data]
                first = inside.copy()
                first[1:] &= ~inside[:-1]
                at = bounds[:-1][bounds[:-1] < bounds[1:]]  # a text that begins with a word, after one that ends with a word
                first[at] = inside[at]
                upto = np.concatenate([[0], np.cumsum(first)])
                n_words = upto[bounds[1:]] - upto[bounds[:-1]]
                whole = data.tobytes()
                rows = [scan_text(whole[a:b], automata) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.record_batch(
                    [
                        part.column(0).cast(pa.int64()),
                        pa.array(n_words, pa.int64()),
                        pa.array([len(s) for s, *_ in rows], pa.int64()),
                        pa.array([min(s, default=None) for s, *_ in rows], pa.int64()),
                        pa.array([max(s, default=None) for s, *_ in rows], pa.int64()),
                        pa.array([",".join(sorted(b)) for _, b, *_ in rows], pa.string()),
                        pa.array([",".join(sorted(b | {p[0] for p in places})) for _, b, places, _ in rows], pa.string()),
                        pa.array([score for *_, score in rows], pa.float64()),
                        pa.array([[dict(zip(("label", "start", "end"), p, strict=True)) for p in places] for _, _, places, _ in rows], pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))),
                    ],
                    names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"],
                )

    return docs.selectExpr(f"`{doc_id}` as doc_id", f"`{text}` as text").mapInArrow(scan, SCHEMA)
