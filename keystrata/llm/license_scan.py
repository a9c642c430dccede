"""License scans by template matching.

A template is license wording with markup: ``<<opt>> ... <</opt>>`` encloses words that may be absent, ``<<var N>>`` stands for
up to N words of any kind (names, years, versions). It is compiled to a token automaton, which accepts a text only
if all mandatory words are there, in order and unchanged. A scan hashes all words of a chunk at once, finds where
the first two words of a template stand (the first alone if any word may be the second), and runs the automaton from there only.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.shared import map_arrow
from keystrata.llm.textbytes import ALNUM_LOWER, Texts, Words, chunks

#: Fixed values of the contract: label of each phrase.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: What follows a GNU license's version number, and the versions of the Creative Commons licenses with their areas.
_LATER = "<<opt>>of the license<</opt>> <<opt>>or at your option any later version<</opt>>"
_CC_VERSIONS = ("4 0 <<opt>>international<</opt>>", "3 0 <<opt>>unported<</opt>>", "2 5 <<opt>>generic<</opt>>", "2 0 <<opt>>generic<</opt>>", "1 0 <<opt>>generic<</opt>>")


def _cc(*names: str) -> list[str]:
    """Full names of a Creative Commons license; without a version, "license" has to follow, as in cc-by's template."""
    versioned = [f"creative commons attribution {n} {v} <<opt>>public<</opt>> <<opt>>license<</opt>>" for n in names for v in _CC_VERSIONS]
    return versioned + [f"creative commons attribution {n} <<opt>>international<</opt>> <<opt>>public<</opt>> license" for n in names]


#: Short notices and opening clauses of public licenses; whole ones follow, under labels of their own.
TEMPLATES = {
    "apache-2.0": ["licensed under the apache license version 2 0 <<opt>>the license you may not use this file except in compliance with the license<</opt>>"],
    "mit": [
        "<<opt>>released<</opt>> <<opt>>licensed<</opt>> under the <<opt>>terms of the<</opt>> mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    ],
    "gpl-2.0": [f"under the <<opt>>terms of the<</opt>> gnu general public license <<opt>>as published by the free software foundation<</opt>> <<opt>>either<</opt>> version 2 {_LATER}"],
    "gpl-3.0": [f"under the <<opt>>terms of the<</opt>> gnu general public license <<opt>>as published by the free software foundation<</opt>> <<opt>>either<</opt>> version 3 {_LATER}"],
    "lgpl": ["under the <<opt>>terms of the<</opt>> gnu lesser general public license"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "isc": ["permission to use copy modify and <<opt>>or<</opt>> distribute this software for any purpose with or without fee is hereby granted"],
    "mpl-2.0": ["subject to the terms of the mozilla public license v 2 0"],
    "cc-by": ["under <<opt>>a<</opt>> cc by 4 0", "creative commons attribution <<opt>>4 0<</opt>> <<opt>>international<</opt>> license"],
    "cc-by-nc": ["under <<opt>>a<</opt>> cc by nc <<opt>>4 0<</opt>>", *_cc("noncommercial", "non commercial")],
    "cc-by-sa": ["under <<opt>>a<</opt>> cc by sa <<opt>>4 0<</opt>>", *_cc("sharealike", "share alike")],
    "cc-by-nc-sa": _cc("noncommercial sharealike", "noncommercial share alike", "non commercial share alike"),
    "cc-by-nd": _cc("noderivatives", "noderivs", "no derivatives", "no derivs"),
    "cc-by-nc-nd": _cc("noncommercial noderivatives", "noncommercial noderivs", "noncommercial no derivatives", "noncommercial no derivs", "non commercial no derivs"),
    "copyright": ["copyright <<opt>>c<</opt>> <<var 12>> all rights reserved"],
}
#: Whole licenses and notices: all of their wording is mandatory, names of holders aside.
TEMPLATES |= {
    "mit-full": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice <<opt>>including the next paragraph<</opt>> shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the <<var 12>> be liable for any claim damages or other liability "
        "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
    ],
    "isc-full": [
        "permission to use copy modify and <<opt>>or<</opt>> distribute this software for any purpose with or without fee is hereby granted "
        "provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and <<var 12>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall <<var 12>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
    ],
    "bsd-full": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "<<opt>>1<</opt>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "<<opt>>2<</opt>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution "
        "<<opt>><<opt>>3<</opt>> neither the name of <<var 12>> nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission<</opt>> "
        "this software is provided by <<var 16>> as is and any express or implied warranties including but not limited to "
        "the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var 16>> be liable for any "
        "direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
        "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort "
        "including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
    ],
    "apache-2.0-full": [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license"
    ],
    "gpl-notice-full": [
        "is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        f"<<opt>>either<</opt>> version <<var 1>> {_LATER} <<var 4>> is distributed in the hope that it will be useful but without any warranty "
        "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"
    ],
}
_MARK = re.compile(r"<<opt>>|<</opt>>|<<var (\d+)>>|[^\s<]+")


class Automaton:
    """States are numbers; ``words`` has the word transitions, ``any`` those that take any word, ``free`` those that take none."""

    def __init__(self, template: str):
        self.words: dict[int, dict[bytes, int]] = defaultdict(dict)
        self.any: dict[int, int] = {}
        self.free: dict[int, list[int]] = defaultdict(list)
        state, opened = 0, []
        fresh = 0
        for m in _MARK.finditer(template):
            token = m[0]
            if token == "<<opt>>":
                opened.append(state)
            elif token == "<</opt>>":
                fresh += 1
                self.free[opened.pop()].append(fresh)
                self.free[state].append(fresh)
                state = fresh
            elif m[1]:
                fresh += 1
                end = fresh
                for _ in range(int(m[1])):
                    self.free[state].append(end)
                    fresh += 1
                    self.any[state] = fresh
                    state = fresh
                self.free[state].append(end)
                state = end
            else:
                fresh += 1
                self.words[state][token.encode()] = fresh
                state = fresh
        if opened:
            raise ValueError(f"<<opt>> isn't closed: {template}")
        self.accept = state

    def closure(self, states: set[int]) -> set[int]:
        seen, todo = set(states), list(states)
        while todo:
            for s in self.free.get(todo.pop(), ()):
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def step(self, states: set[int], word: bytes) -> set[int]:
        out = {self.words[s][word] for s in states if s in self.words and word in self.words[s]}
        out |= {self.any[s] for s in states if s in self.any}
        return self.closure(out)

    def match(self, word_at, start: int, end: int) -> int | None:
        """The end of the longest match that begins at ``start``, or None."""
        states, best = self.closure({0}), None
        for k in range(start, end):
            states = self.step(states, word_at(k))
            if not states:
                break
            if self.accept in states:
                best = k + 1
        return best

    def openings(self) -> set[tuple[bytes, ...]]:
        """What a match can begin with: pairs of words, or a first word alone if any word, or none, may follow it."""
        out: set[tuple[bytes, ...]] = set()
        for s in self.closure({0}):
            if s in self.any:
                raise ValueError("a template can't begin with <<var>>")
            for first, to in self.words.get(s, {}).items():
                for t in self.closure({to}):
                    if t in self.any or t == self.accept:
                        out.add((first,))
                    out |= {(first, second) for second in self.words.get(t, {})}
        return {o for o in out if len(o) == 1 or o[:1] not in out}


def hashes_of(words: list[bytes]) -> np.ndarray:
    return Words(Texts(pa.array(words, pa.binary())), ~np.zeros(256, dtype=bool)).hashes()


def _runs(words: Words, h: np.ndarray, last: np.ndarray, phrase: list[bytes]) -> np.ndarray:
    """Where the phrase's words stand consecutively within a text."""
    n = len(phrase)
    if len(h) < n:
        return np.zeros(0, dtype=np.int64)
    hit = np.arange(len(h) - n + 1) + n <= last[: len(h) - n + 1]
    for j, x in enumerate(hashes_of(phrase)):
        hit &= h[j : len(h) - n + 1 + j] == x
    at = np.flatnonzero(hit)
    return at[[[words.bytes_of(int(k) + j) for j in range(n)] == phrase for k in at]] if len(at) else at


_OUT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,from:long,to:long>>"
_SPAN = pa.list_(pa.struct([("label", pa.string()), ("from", pa.int64()), ("to", pa.int64())]))


def _scan(batches, base: dict[str, str], templates: dict[str, list[str]]):
    automata = [(label, Automaton(t)) for label, ts in templates.items() for t in ts]
    openings: dict[tuple[bytes, ...], list] = defaultdict(list)
    for label, a in automata:
        for opening in a.openings():
            openings[opening].append((label, a))
    phrases = [(p.encode().split(), label) for p, label in base.items()]
    for chunk in chunks(batches):
        words = Words(Texts(chunk.column(1), lower=True), ALNUM_LOWER)
        h, owner = words.hashes(), words.owner()
        last = words.first[1:][owner]
        n = len(words.counts)
        spans: dict[int, list] = defaultdict(list)
        starts: dict[int, list] = defaultdict(list)
        for phrase, label in phrases:
            for k in _runs(words, h, last, phrase).tolist():
                at = k - int(words.first[owner[k]])
                starts[int(owner[k])].append((at, label))
                spans[int(owner[k])].append({"label": label, "from": at, "to": at + len(phrase)})
        for opening, opened in openings.items():
            for k in _runs(words, h, last, list(opening)).tolist():
                first = int(words.first[owner[k]])
                for label, automaton in opened:
                    end = automaton.match(words.bytes_of, k, int(last[k]))
                    if end is not None:
                        spans[int(owner[k])].append({"label": label, "from": k - first, "to": end - first})
        rows = []
        for i in range(n):
            found = starts.get(i, ())
            own = sorted({(s["from"], s["to"], s["label"]) for s in spans.get(i, ())})
            covered, reach = 0, 0
            for a, b, _ in own:
                covered += max(0, b - max(a, reach))
                reach = max(reach, b)
            base_labels = {x for _, x in found}
            rows.append((
                len(found), min((x for x, _ in found), default=None), max((x for x, _ in found), default=None),
                ",".join(sorted(base_labels)), ",".join(sorted(base_labels | {x for _, _, x in own})),
                covered / int(words.counts[i]) if covered else 0.0, [{"label": x, "from": a, "to": b} for a, b, x in own],
            ))
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), _SPAN]
        arrays = [chunk.column(0).cast(pa.int64()), pa.array(words.counts.astype(np.int64)), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])


def scan_licenses(docs: DataFrame, base: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """One row for each row of ``docs``: counts and labels of base phrases, labels of templates too, and the spans of both in words.

    score is the share of the text's words that license wording covers. Null and empty texts have no words, no
    labels (empty strings), null first_word and last_word and score 0. Rows are judged on their own, so repeated rows give
    repeated results and a null doc_id stays null; other columns of ``docs`` are ignored.
    """
    base, templates = BASE if base is None else base, TEMPLATES if templates is None else templates
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), lambda it: _scan(it, base, templates), _OUT)


def query(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")
