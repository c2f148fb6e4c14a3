"""License scans: template-markup matching.

A template is licence wording with two kinds of marks: <<optional>> ... <</optional>> encloses words that
may be missing, and <<any:LOW-HIGH>> or <<one:a|b|c d>> stands for replaceable words (a count of arbitrary words, or one of
the listed wordings). Templates are compiled into token automata without empty steps and run over the words of a text: a
text is accepted at a place where all mandatory wording stands there exactly, in order.

Base labels come from consecutive words of fixed phrases (see PHRASES), independent of the templates.

Defined results: a null or empty text has no words, no labels, null first and last word, and score 0. score is
1 where a template is accepted, 0.5 where only a base phrase stands, else 0. Repeated rows give equal rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from rankweave.llm.common import bound_batches, plain_words, texts_of

# The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# What the licences of two and three clauses share.
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "<<optional>>1.<</optional>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "<<optional>>2.<</optional>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY <<any:1-12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL <<any:1-12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) "
    "ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
)

# Templates by label. Wording of public licences and notices.
TEMPLATES = {
    "mit-notice": "<<optional>><<one:this work is|this software is|this project is>><</optional>> <<one:released|licensed|distributed|available>> under the <<optional>>terms of the<</optional>> MIT License",
    "apache-2.0-notice": "<<optional>><<one:this work is|this software is>><</optional>> <<one:released|licensed|distributed|available>> under the <<optional>>terms of the<</optional>> Apache License <<optional>>,<</optional>> version 2.0",
    "gpl-3.0-notice": "<<optional>><<one:this work is|this software is|this program is>><</optional>> <<one:released|licensed|distributed|available>> under the <<optional>>terms of the<</optional>> GNU General Public License <<one:version 3|v3|3.0|version 3.0>>",
    "gpl-2.0-notice": "<<optional>><<one:this work is|this software is|this program is>><</optional>> <<one:released|licensed|distributed|available>> under the <<optional>>terms of the<</optional>> GNU General Public License <<one:version 2|v2|2.0|version 2.0>>",
    "cc-by-nc-4.0-notice": "<<one:released|licensed|distributed|available>> under <<optional>>a<</optional>> <<optional>>creative commons<</optional>> <<one:CC BY-NC|attribution noncommercial>> 4.0 <<optional>>international<</optional>>",
    "cc-by-4.0-notice": "<<one:released|licensed|distributed|available>> under <<optional>>a<</optional>> <<optional>>creative commons<</optional>> <<one:CC BY|attribution>> 4.0 <<optional>>international<</optional>>",
    "mit-text": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files <<optional>>(the "Software")<</optional>>, '
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice <<optional>>(including the next paragraph)<</optional>> shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL <<any:1-12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"
    ),
    "isc-text": (
        "Permission to use, copy, modify, and<<optional>>/or<</optional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND <<any:1-12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL <<any:1-12>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"
    ),
    "bsd-2-clause-text": f"{_BSD} {_BSD_END}",
    "bsd-3-clause-text": (
        f"{_BSD} <<optional>>3.<</optional>> Neither the name of <<any:1-12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}"
    ),
    "apache-2.0-text": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at <<any:1-12>> '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License"
    ),
    "gpl-text": (
        "This program is free software<<optional>>:<</optional>> you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"
        "<<one:, either version 3 of the License, or (at your option) any later version|; either version 2 of the License, or (at your option) any later version|, version 3|; version 2 of the License>>. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        "See the GNU General Public License for more details"
    ),
}

#: Arbitrary word of a replaceable region.
ANY = None


class Automaton:
    """Token automaton of one template: states are numbers, steps are (word or ANY) -> states, without empty steps."""

    def __init__(self, template: str) -> None:
        self._empty: dict[int, set[int]] = defaultdict(set)
        self._step: dict[int, dict[bytes | None, set[int]]] = defaultdict(lambda: defaultdict(set))
        self._last = 0
        end = self._build(template, 0)
        reach = {s: self._closure(s) for s in range(self._last + 1)}
        self.steps: dict[int, dict[bytes | None, frozenset[int]]] = {}
        for s in range(self._last + 1):
            out: dict[bytes | None, set[int]] = defaultdict(set)
            for r in reach[s]:
                for word, to in self._step[r].items():
                    out[word] |= to
            self.steps[s] = {w: frozenset(to) for w, to in out.items()}
        self.accepting = frozenset(s for s in range(self._last + 1) if end in reach[s])
        if 0 in self.accepting:
            raise ValueError("a template needs mandatory wording")

    def _new(self) -> int:
        self._last += 1
        return self._last

    def _closure(self, state: int) -> set[int]:
        seen, todo = {state}, [state]
        while todo:
            for to in self._empty[todo.pop()] - seen:
                seen.add(to)
                todo.append(to)
        return seen

    def _words(self, text: str, state: int) -> int:
        for w in plain_words(text):
            to = self._new()
            self._step[state][w].add(to)
            state = to
        return state

    def _build(self, template: str, state: int) -> int:
        starts: list[int] = []
        for part in re.split(r"(<<[^>]*>>)", template):
            if part == "<<optional>>":
                starts.append(state)
            elif part == "<</optional>>":
                self._empty[starts.pop()].add(state)
            elif part.startswith("<<any:"):
                low, high = map(int, part[6:-2].split("-"))
                ends = [state] if low == 0 else []
                for k in range(1, high + 1):
                    to = self._new()
                    self._step[state][ANY].add(to)
                    state = to
                    if k >= low:
                        ends.append(state)
                state = self._new()
                for e in ends:
                    self._empty[e].add(state)
            elif part.startswith("<<one:"):
                join = self._new()
                for wording in part[6:-2].split("|"):
                    self._empty[self._words(wording, state)].add(join)
                state = join
            elif part.startswith("<<"):
                raise ValueError(f"unknown mark {part}")
            else:
                state = self._words(part, state)
        if starts:
            raise ValueError("an optional region isn't closed")
        return state

    def starts(self) -> frozenset[bytes | None]:
        return frozenset(self.steps[0])

    def match(self, words: list[bytes], at: int) -> int:
        """Number of words of the shortest accepted wording at this place, or 0."""
        states = {0}
        for n in range(at, len(words)):
            word, after = words[n], set()
            for s in states:
                step = self.steps[s]
                after |= step.get(word, frozenset()) | step.get(ANY, frozenset())
            if not after:
                return 0
            if after & self.accepting:
                return n - at + 1
            states = after
        return 0


def scan_words(words: list[bytes], automata: dict[str, Automaton], by_start: dict[bytes | None, list[str]]) -> tuple[int, int | None, int | None, set[str], set[str]]:
    """Base places, first and last base start, base labels, labels of accepted templates."""
    at: dict[bytes, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        if w in by_start or w in _FIRST:
            at[w].append(i)
    places: list[int] = []
    base: set[str] = set()
    for phrase, label in _PHRASE_WORDS:
        for i in at.get(phrase[0], ()):
            if words[i : i + len(phrase)] == phrase:
                places.append(i)
                base.add(label)
    accepted = {label for w, where in at.items() for label in by_start.get(w, ()) if any(automata[label].match(words, i) for i in where)}
    # a template that starts with a replaceable region may start anywhere
    accepted |= {label for label in by_start.get(ANY, ()) if label not in accepted and any(automata[label].match(words, i) for i in range(len(words)))}
    return len(places), min(places, default=None), max(places, default=None), base, accepted


_PHRASE_WORDS = [(p.encode().split(), label) for p, label in PHRASES.items()]
_FIRST = {p[0] for p, _ in _PHRASE_WORDS}

_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())]
)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    bound_batches(docs.sparkSession)
    for t in templates.values():
        Automaton(t)  # an ill-formed template fails here, on the driver

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = {label: Automaton(t) for label, t in templates.items()}
        by_start: dict[bytes | None, list[str]] = defaultdict(list)
        for label, a in automata.items():
            for w in a.starts():
                by_start[w].append(label)
        for batch in batches:
            rows = []
            for text in texts_of(batch):
                words = plain_words(text)
                n, first, last, base, accepted = scan_words(words, automata, by_start)
                rows.append((len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(base | accepted)), 1.0 if accepted else 0.5 if n else 0.0))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(columns, list(_SCHEMA)[1:], strict=True))], schema=_SCHEMA)

    ddl = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "text").mapInArrow(run, ddl)
