"""License scans: templates with optional and replaceable regions, compiled into token automata.

Template markup: plain words are mandatory wording; ``<<beginOptional>> ... <<endOptional>>`` may be
absent, and may be nested; ``<<var;max=n>>`` is a replaceable region of at most n words, ``<<var;max=n;match=pattern>>`` one
whose words each match the pattern whole. A text is accepted where the mandatory words follow one another
exactly. Texts are compared as words: A-Z lower-cased, runs of digits, letters a-z and characters beyond ASCII.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
    to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
    whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
    permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or
    substantial portions of the Software."""
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
    WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;max=12>> BE LIABLE
    FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
    CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
    following conditions are met: <<var;max=1;match=[1a]>> Redistributions of source code must retain the above copyright notice,
    this list of conditions and the following disclaimer. <<var;max=1;match=[2b]>> Redistributions in binary form must reproduce the
    above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
    provided with the distribution."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY <<var;max=12>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
    THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var;max=12>> BE
    LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
    PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
    ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
    OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_COPYRIGHT = "<<beginOptional>>Copyright <<var;max=1;match=c|©>> <<var;max=16>> <<beginOptional>>All rights reserved<<endOptional>><<endOptional>>"
#: The wording of common notices and of whole license texts.
TEMPLATES = [
    ("mit", "<<beginOptional>>This <<var;max=2>> is<<endOptional>> released under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    ("mit", "licensed under the <<beginOptional>>terms of the<<endOptional>> MIT License"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("mit", _MIT_GRANT),
    ("mit-full", f"<<beginOptional>><<beginOptional>>The<<endOptional>> MIT License <<beginOptional>>(MIT)<<endOptional>><<endOptional>> {_COPYRIGHT} {_MIT_GRANT} {_MIT_WARRANTY}"),
    ("apache", "licensed under the Apache License <<beginOptional>>Version <<var;max=2;match=[0-9]+>><<endOptional>>"),
    ("apache", "SPDX-License-Identifier: Apache-2.0"),
    ("apache-header", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this <<var;max=2>> except in compliance with the
        License. You may obtain a copy of the License at <<beginOptional>><<var;max=1;match=https?>>://www.apache.org/licenses/LICENSE-2.0<<endOptional>> Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
        WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License."""),
    ("gpl", "<<beginOptional>>This <<var;max=3>> is<<endOptional>> licensed under the GNU <<beginOptional>>Affero<<endOptional>> <<beginOptional>>Lesser<<endOptional>> General Public License <<beginOptional>>version <<var;max=2>><<endOptional>>"),
    ("gpl", """This <<var;max=3>> is free software<<beginOptional>>:<<endOptional>> you can redistribute it and/or modify it under the terms
        of the GNU <<beginOptional>>Lesser<<endOptional>> General Public License as published by the Free Software Foundation"""),
    ("gpl", "SPDX-License-Identifier: <<var;max=1;match=a?l?gpl>>-<<var;max=2;match=[0-9]+>><<beginOptional>>only<<endOptional>><<beginOptional>>or-later<<endOptional>>"),
    ("cc-by-nc", "licensed under <<beginOptional>>a<<endOptional>> CC BY-NC <<beginOptional>>4.0<<endOptional>>"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial <<var;max=2>> <<beginOptional>>International<<endOptional>> License"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met"""),
    ("bsd-2-clause", f"{_COPYRIGHT} {_BSD_CONDITIONS} {_BSD_WARRANTY}"),
    ("bsd-3-clause", f"""{_COPYRIGHT} {_BSD_CONDITIONS} <<var;max=1;match=[3c]>> Neither the name of <<var;max=12>> nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission. {_BSD_WARRANTY}"""),
    ("isc", """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or
        without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"""),
    ("isc-full", """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
        <<var;max=8>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO
        EVENT SHALL <<var;max=8>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
        LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH
        THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("zlib", """This software is provided <<var;max=2>> as-is <<var;max=2>>, without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
        misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
        product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
]
#: Every ASCII byte that is in no word, and the upper-case letters, as blank and lower case.
_FOLD = bytes(b if b >= 0x80 or chr(b).isdigit() or "a" <= chr(b) <= "z" else b + 32 if "A" <= chr(b) <= "Z" else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_FOLD).split()


class Automaton:
    """A template over tokens: states 0..n, each with word, any-word and empty transitions."""

    def __init__(self, template: str):
        self.word: list[dict[bytes, int]] = [{}]
        self.any: list[tuple[int, re.Pattern] | None] = [None]
        self.empty: list[list[int]] = [[]]
        open_, at = [], 0
        for piece in re.split(r"(<<[^>]*>>)", template):
            if piece == "<<beginOptional>>":
                open_.append(at)
            elif piece == "<<endOptional>>":
                self.empty[open_.pop()].append(at)
            elif m := re.fullmatch(r"<<var;max=(\d+)(?:;match=(.+))?>>", piece):
                passed, pattern = [], re.compile((m[2] or "(?s:.*)").encode())
                for _ in range(int(m[1])):
                    passed.append(at)
                    at = self._step(at, pattern)
                for s in passed:
                    self.empty[s].append(at)
            elif piece.startswith("<<"):
                raise ValueError(f"no such markup: {piece}")
            else:
                for w in words(piece):
                    at = self._step(at, w)
        if open_:
            raise ValueError("an optional region isn't ended")
        self.final = at
        self.starts = self._moves({0})
        self.first = {w for s in self.starts for w in self.word[s]}
        self.opens = [self.any[s][1] for s in self.starts if self.any[s]]  # patterns of replaceable regions that a match can begin with
        self.needs = max(sorted(set(self._mandatory(template))), key=len)

    def begins(self, word: bytes) -> bool:
        """Whether a match can begin with ``word``."""
        return word in self.first or any(p.fullmatch(word) for p in self.opens)

    @staticmethod
    def _mandatory(template: str) -> list[bytes]:
        found, depth = [], 0
        for piece in re.split(r"(<<[^>]*>>)", template):
            depth += (piece == "<<beginOptional>>") - (piece == "<<endOptional>>")
            found += [] if depth or piece.startswith("<<") else words(piece)
        return found

    def _step(self, at: int, word: bytes | re.Pattern) -> int:
        self.word.append({})
        self.any.append(None)
        self.empty.append([])
        new = len(self.word) - 1
        if isinstance(word, bytes):
            self.word[at][word] = new
        else:
            self.any[at] = new, word
        return new

    def _moves(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.empty[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def match(self, text: list[bytes], start: int) -> int | None:
        """End of the longest accepted run of words from ``start``."""
        states, end = self.starts, None
        for i in range(start, len(text)):
            w = text[i]
            new = {t for s in states if (t := self.word[s].get(w)) is not None}
            new |= {a[0] for s in states if (a := self.any[s]) and a[1].fullmatch(w)}
            if not new:
                break
            states = self._moves(new)
            if self.final in states:
                end = i + 1
        return end


class Matcher:
    def __init__(self, templates: list[tuple[str, str]] = TEMPLATES):
        self.automata = [(label, Automaton(t)) for label, t in templates]
        self.needed = {a.needs for _, a in self.automata}
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in PHRASES.items()]

    def phrase_places(self, joined: bytes) -> list[tuple[int, str]]:
        """(word index, label) of every place of a phrase in `` w w w ``."""
        found = []
        for phrase, label in self.phrases:
            at, word, counted = joined.find(phrase), 0, 0
            while at >= 0:
                word += joined.count(b" ", counted, at)
                counted = at
                found.append((word, label))
                at = joined.find(phrase, at + 1)
        return sorted(found)

    def accepted(self, text: list[bytes], joined: bytes) -> list[tuple[int, int, str]]:
        """(first word, end, label) of the template matches, leftmost and longest per template."""
        found = []
        there = {w for w in self.needed if w in joined}
        for label, a in self.automata:
            if a.needs not in there:
                continue
            i = 0
            while i < len(text):
                end = a.match(text, i) if a.begins(text[i]) else None
                if end:
                    found.append((i, end, label))
                i = end or i + 1
        return sorted(found)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Licenses named or granted in every row of ``docs``.

    doc_id, n_words, n_base (places of the phrases), first_word and last_word (their smallest and largest
    start, null if none), base_labels, labels (templates' too), score (1: a template is accepted; 0.5:
    only a phrase is there; 0: neither), places (array of first word, end, label of template matches).
    Null texts count as empty: no words, no places, null first and last word, no labels, score 0. Texts of any length are
    matched whole; repeated rows and null ids are returned as they are, an empty table as one; other columns, whatever
    their names, aren't read.
    """
    place = pa.struct([("first", pa.int64()), ("end", pa.int64()), ("label", pa.string())])
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
        ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("places", pa.list_(place)),
    ])

    def one(matcher: Matcher, text: str | None) -> tuple:
        text_words = words(text)
        joined = b" " + b" ".join(text_words) + b" "
        base, full = matcher.phrase_places(joined), matcher.accepted(text_words, joined)
        base_labels = {label for _, label in base}
        return (
            len(text_words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(base_labels)),
            ",".join(sorted(base_labels | {label for *_, label in full})), 1.0 if full else 0.5 if base else 0.0,
            [dict(zip(("first", "end", "label"), x, strict=True)) for x in full],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(templates)
        for b in batches:
            rows = [one(matcher, t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], schema.field(k + 1).type) for k in range(8))], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<first:long,end:long,label:string>>"
    )
