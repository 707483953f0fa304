"""License scans with template markup.

A template is wording with ``<<beginOptional>>..<<endOptional>>`` around text that may be
missing and ``<<var;max=N>>`` for up to N replaceable words. It is compiled to an automaton over
words. A text is accepted where the automaton runs through: all mandatory words are there, in
order and exactly, and nothing else but optional and replaceable parts. Long texts are scanned
whole; the automaton runs only in texts that hold each template's longest mandatory run.

Plain phrases are found besides: places where their words stand one after the other.
"""

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Public license wording, with markup.
TEMPLATES = {
    "mit-notice": "<<beginOptional>>this <<var;max=2>> is<<endOptional>> <<beginOptional>>released<<endOptional>>"
    "<<beginOptional>>licensed<<endOptional>> under the mit license",
    "apache-2.0-notice": "licensed under the apache license version 2 0"
    "<<beginOptional>> the license you may not use this file except in compliance with the license<<endOptional>>",
    "cc-by-nc-4.0-notice": "licensed under <<beginOptional>>the creative commons<<endOptional>> cc by nc 4 0",
    "gpl-3.0-notice": "licensed under the <<beginOptional>>terms of the<<endOptional>> gnu general public license "
    "<<beginOptional>>as published by the free software foundation<<endOptional>> version 3",
    "bsd-3-clause-notice": "licensed under the bsd 3 clause license",
    "mit-text": "<<beginOptional>>the mit license<<endOptional>> <<beginOptional>>mit<<endOptional>> "
    "<<beginOptional>>copyright <<var;max=24>><<endOptional>> permission is hereby granted free of charge to any "
    "person obtaining a copy of this software and associated documentation files the software to deal in the "
    "software without restriction including without limitation the rights to use copy modify merge publish "
    "distribute sublicense and or sell copies of the software and to permit persons to whom the software is "
    "furnished to do so subject to the following conditions the above copyright notice and this permission notice "
    "<<beginOptional>>including the next paragraph<<endOptional>> shall be included in all copies or substantial "
    "portions of the software the software is provided as is without warranty of any kind express or implied "
    "including but not limited to the warranties of merchantability fitness for a particular purpose and "
    "noninfringement in no event shall <<var;max=12>> be liable for any claim damages or other liability whether in "
    "an action of contract tort or otherwise arising from out of or in connection with the software or the use or "
    "other dealings in the software",
    "isc-text": "<<beginOptional>>copyright <<var;max=24>><<endOptional>> permission to use copy modify and or "
    "distribute this software for any purpose with or without fee is hereby granted provided that the above copyright "
    "notice and this permission notice appear in all copies",
    "bsd-2-clause-text": "<<beginOptional>>copyright <<var;max=24>><<endOptional>> redistribution and use in source and "
    "binary forms with or without modification are permitted provided that the following conditions are met "
    "<<beginOptional>>1<<endOptional>> redistributions of source code must retain the above copyright notice this list "
    "of conditions and the following disclaimer <<beginOptional>>2<<endOptional>> redistributions in binary form must "
    "reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
    "and or other materials provided with the distribution <<beginOptional>>3<<endOptional>> "
    "<<beginOptional>>neither the name of <<var;max=16>> nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission<<endOptional>> this software "
    "is provided by <<var;max=10>> as is and any express or implied warranties including but not limited to the implied "
    "warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var;max=10>> "
    "be liable for any direct indirect incidental special exemplary or consequential damages including but not limited "
    "to procurement of substitute goods or services loss of use data or profits or business interruption however caused "
    "and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
    "arising in any way out of the use of this software even if advised of the possibility of such damage",
    "bsd-3-clause-condition": "neither the name of <<var;max=16>> nor the names of its contributors may be used to endorse "
    "or promote products derived from this software without specific prior written permission",
    "apache-2.0-header": "<<beginOptional>>copyright <<var;max=12>><<endOptional>> licensed under the apache license "
    "version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the "
    "license at <<var;max=8>> unless required by applicable law or agreed to in writing software distributed under the "
    "license is distributed on an as is basis without warranties or conditions of any kind either express or implied see "
    "the license for the specific language governing permissions and limitations under the license",
    "gpl-header": "<<beginOptional>>this program is free software<<endOptional>> you can redistribute it and or modify it "
    "under the terms of the gnu general public license as published by the free software foundation "
    "<<beginOptional>>either<<endOptional>> version <<var;max=1>> <<beginOptional>>of the license<<endOptional>> "
    "<<beginOptional>>or at your option any later version<<endOptional>>",
    "lgpl-header": "you can redistribute it and or modify it under the terms of the gnu "
    "<<beginOptional>>lesser<<endOptional>><<beginOptional>>library<<endOptional>> general public license as published by "
    "the free software foundation <<beginOptional>>either<<endOptional>> version <<var;max=2>> "
    "<<beginOptional>>of the license<<endOptional>> <<beginOptional>>or at your option any later version<<endOptional>>",
    "mpl-2.0-header": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the "
    "mpl was not distributed with this file you can obtain one at <<var;max=6>>",
    "zlib-text": "this software is provided as is without any express or implied warranty in no event will the authors be "
    "held liable for any damages arising from the use of this software permission is granted to anyone to use this "
    "software for any purpose including commercial applications and to alter it and redistribute it freely subject to the "
    "following restrictions",
    "cc-4.0-notice": "this work is licensed under <<beginOptional>>a<<endOptional>><<beginOptional>>the<<endOptional>> "
    "creative commons attribution <<beginOptional>>noncommercial<<endOptional>><<beginOptional>>non commercial<<endOptional>> "
    "<<beginOptional>>sharealike<<endOptional>><<beginOptional>>share alike<<endOptional>><<beginOptional>>noderivatives<<endOptional>> "
    "4 0 international <<beginOptional>>public<<endOptional>> license",
    "unlicense-text": "this is free and unencumbered software released into the public domain anyone is free to copy "
    "modify publish use compile sell or distribute this software either in source code form or as a compiled binary for "
    "any purpose commercial or non commercial and by any means",
}

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(WORD)
_MARK = re.compile(r"<<(beginOptional|endOptional|var;max=(\d+))>>")
_A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: By byte of lower-cased UTF-8: whether it is part of a word.
_IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])


@dataclass
class Automaton:
    """States are numbered; ``words[s]`` is what leads on from s (None: any word), ``skips[s]``
    the states that s reaches without a word. The last state accepts."""

    words: list = field(default_factory=list)
    skips: list = field(default_factory=list)
    runs: list = field(default_factory=list)  # mandatory runs of words

    def closed(self, states: dict[int, int]) -> dict[int, int]:
        """With what is reachable without a word; a state keeps its least start."""
        todo = list(states)
        while todo:
            s = todo.pop()
            for t in self.skips[s]:
                if states.get(t, states[s] + 1) > states[s]:
                    states[t] = states[s]
                    todo.append(t)
        return states

    def spans(self, words: list[str]) -> list[tuple[int, int]]:
        """First word and end of the accepted places, longest for each end that isn't inside another."""
        final, live, found = len(self.words) - 1, {}, []
        for i, word in enumerate(words):
            live = self.closed({**{0: i}, **live} if 0 not in live else live)
            after: dict[int, int] = {}
            for s, start in live.items():
                if s < final and (self.words[s] is None or self.words[s] == word):
                    after[s + 1] = min(start, after.get(s + 1, start))
            live = self.closed(after)
            if final in live:
                found.append((live[final], i + 1))
        out: list[tuple[int, int]] = []
        for a, b in found:
            while out and a <= out[-1][0]:
                out.pop()
            out.append((a, b))
        return out


def compile_template(text: str) -> Automaton:
    """The automaton of a template. Raises ValueError if markup isn't balanced or nothing is
    mandatory."""
    m, opened, run, at = Automaton(), [], [], 0

    def words_of(part: str) -> None:
        for w in _WORD.findall(part.translate(_A_TO_Z)):
            m.words.append(w)
            m.skips.append([])
            if not opened:
                run.append(w)

    def end_run() -> None:
        if run:
            m.runs.append(list(run))
            run.clear()

    for mark in _MARK.finditer(text):
        words_of(text[at : mark.start()])
        at = mark.end()
        end_run()
        if mark[1] == "beginOptional":
            opened.append(len(m.words))
        elif mark[1] == "endOptional":
            if not opened:
                raise ValueError("endOptional without beginOptional")
            start = opened.pop()
            if len(m.words) > start:
                m.skips[start].append(len(m.words))
        else:
            n = int(mark[2])
            end = len(m.words) + n
            for s in range(len(m.words), end):
                m.words.append(None)
                m.skips.append([end])
    words_of(text[at:])
    end_run()
    if opened or not m.runs:
        raise ValueError("beginOptional without endOptional" if opened else "nothing is mandatory")
    m.words.append("")  # the accepting state
    m.skips.append([])
    return m


def words_before(text: str) -> np.ndarray:
    """For each character how many words begin before it."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _IN_WORD[np.minimum(code, 128)]
    starts = inside & ~np.concatenate([[False], inside[:-1]])
    return np.cumsum(starts) - starts


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        split = lambda p: _WORD.findall(p.translate(_A_TO_Z))
        consecutive = lambda ws: f"(?<!{WORD[:-1]})(?={GAP.join(map(re.escape, ws))}(?!{WORD[:-1]}))"
        self.phrases = [(len(split(p)), re.compile(consecutive(split(p))), label, max(split(p), key=len)) for p, label in phrases.items()]
        self.templates = []
        for label, text in templates.items():
            m = compile_template(text)
            longest = max(m.runs, key=len)
            self.templates.append((label, m, max(longest, key=len), re.compile(consecutive(longest))))

    def scan(self, text: str | None) -> tuple:
        """``n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` of a text."""
        text = (text or "").translate(_A_TO_Z)
        inside = _IN_WORD[np.frombuffer(text.encode(), np.uint8)]
        n_words = int(inside[:1].sum() + (inside[1:] & ~inside[:-1]).sum())
        places, base, spans, before = [], set(), [], None
        for n, pattern, label, hint in self.phrases:
            if hint in text:
                for m in pattern.finditer(text):
                    before = words_before(text) if before is None else before
                    word = int(before[m.start()])
                    places.append(word)
                    base.add(label)
                    spans.append((word, word + n, label))
        labels, words = set(base), None
        for label, automaton, hint, pattern in self.templates:
            if hint in text and pattern.search(text):
                words = _WORD.findall(text) if words is None else words
                found = automaton.spans(words)
                spans += [(a, b, label) for a, b in found]
                labels |= {label} if found else set()
        covered, end = 0, 0
        for a, b, _ in sorted(spans):
            covered += max(0, b - max(a, end))
            end = max(end, b)
        return (
            n_words,
            len(places),
            min(places, default=None),
            max(places, default=None),
            ",".join(sorted(base)),
            ",".join(sorted(labels)),
            covered / n_words if n_words else 0.0,
            sorted(spans),
        )


SCANNED = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, spans array<struct<first_word:long,end_word:long,label:string>>"
)
_SPANS = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("label", pa.string())]))


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None) -> DataFrame:
    """Scan every whole text; null counts as empty.

    Returns doc_id, n_words, n_base (all places of phrases), first_word and last_word (their
    smallest and largest start; null if there is none), base_labels, labels (phrases' and
    accepted templates'; both distinct, sorted, joined by commas), score (the share of words in
    found places), spans. Other columns are ignored, so their names cannot clash; repeated rows and
    rows without a doc_id stay; texts of any length are scanned whole; an empty table gives no rows.
    """
    phrases, templates = phrases or PHRASES, templates or TEMPLATES
    for t in templates.values():
        compile_template(t)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, templates)
        kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), _SPANS]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in batches:
            rows = [scanner.scan(t) for t in batch.column("text").to_pylist()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            arrays = []
            for c, k in zip(columns, kinds, strict=True):
                if k is _SPANS:
                    c = [[{"first_word": a, "end_word": b, "label": x} for a, b, x in s] for s in c]
                arrays.append(pa.array(c, k))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, SCANNED)
