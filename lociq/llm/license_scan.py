"""License scan by matching template markup.

A template is wording with two kinds of markup: ``<<optional>> words <<end>>`` may be left out, and
``<<any:m-n>>`` stands for m to n words of whatever kind (a name, a year). It is compiled into an automaton over words;
a text carries the template's label if the automaton accepts a run of its words, the mandatory wording
matching exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from lociq.llm.common import texts_of

#: Phrases whose places are counted, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Templates of common license lines and notices, and of whole licenses, and their labels.
TEMPLATES = {
    "apache": "licensed under the <<optional>>terms of the<<end>> apache license <<optional>>version<<end>> <<optional>>2 <<optional>>0<<end>><<end>>",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc": "licensed under <<optional>>a<<end>> <<optional>>creative commons<<end>> cc <<any:1-4>> 4 0",
    "cc-attribution": "creative commons attribution <<any:0-4>> <<optional>>international<<end>> <<optional>>public<<end>> license",
    "copyright": "copyright <<optional>>c<<end>> <<any:1-8>> all rights reserved",
    "gpl-line": "licensed under the <<optional>>terms of the<<end>> <<optional>>gnu<<end>> general public license <<optional>>version <<any:1-1>><<end>>",
    "gpl-notice": "you can redistribute it and or modify it under the terms of the gnu <<optional>>lesser<<end>> general public license as published by the free software foundation",
    "mit": "released under the <<optional>>terms of the<<end>> mit license",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<optional>>the software<<end>> to deal in the software without restriction",
    "mpl": "subject to the terms of the mozilla public license <<optional>>v <<any:1-2>><<end>>",
    # Whole licenses.
    "bsd-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<optional>>1<<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<optional>>2<<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
    "<<optional>> <<optional>>3<<end>> neither the name of <<any:1-12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission <<end>> "
    "this software is provided by <<any:1-10>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall <<any:1-10>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "isc-text": "permission to use copy modify and <<optional>>or<<end>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
    "the software is provided as is and <<any:1-6>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
    "in no event shall <<any:1-6>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
    "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<optional>>the software<<end>> to deal in the software without restriction "
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
    "the above copyright notice and this permission notice <<optional>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall <<any:1-6>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "boost-text": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software "
    "to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following "
    "the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software "
    "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and non infringement "
    "in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "unlicense-text": "this is free and unencumbered software released into the public domain "
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means "
    "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain "
    "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors "
    "we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall the authors be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "zlib-text": "this software is provided as is without any express or implied warranty in no event will the <<any:1-6>> be held liable for any damages arising from the use of this software "
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
    "<<optional>>1<<end>> the origin of this software must not be misrepresented you must not claim that you wrote the original software "
    "if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
    "<<optional>>2<<end>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
    "<<optional>>3<<end>> this notice may not be removed or altered from any source distribution",
    # Whole notices of licenses that are too long to stand in a file.
    "apache-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<any:1-12>> "
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
    "see the license for the specific language governing permissions and limitations under the license",
    "gpl-header": "is free software you can redistribute it and or modify it under the terms of the gnu <<optional>>lesser<<end>> <<optional>>affero<<end>> general public license as published by the free software foundation "
    "either version <<any:1-2>> of the license or <<optional>>at your option<<end>> any later version <<any:1-4>> is distributed in the hope that it will be useful but without any warranty "
    "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu <<optional>>lesser<<end>> <<optional>>affero<<end>> general public license for more details "
    "you should have received a copy of the gnu <<optional>>lesser<<end>> <<optional>>affero<<end>> general public license along with <<any:1-4>> if not",
    "mpl-header": "source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
}

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes to bytes: A-Z lower-cased, what separates words to a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b < 48 or 58 <= b <= 96 or 123 <= b <= 127 else b for b in range(256))
_ANY = b"*"
_MARKUP = re.compile(r"<<optional>>|<<end>>|<<any:(\d+)-(\d+)>>|[^<\s]+")


def mandatory(template: str) -> int:
    """Words that a match has at least: those outside optional parts."""
    depth = n = 0
    for token in _MARKUP.finditer(template):
        if token[0] == "<<optional>>":
            depth += 1
        elif token[0] == "<<end>>":
            depth -= 1
        elif depth == 0:
            n += int(token[1]) if token[1] else 1
    return n


@dataclass
class Automaton:
    """States 0 (start) to n; ``steps[s]`` maps a word, or _ANY, to the next states. No silent steps are left."""

    label: str
    steps: list[dict[bytes, frozenset[int]]]
    final: frozenset[int]
    first: frozenset[bytes]

    def accepts_at(self, words: list[bytes], start: int) -> int | None:
        """The end of the shortest accepted run that begins at ``start``."""
        states = {0}
        for at in range(start, len(words)):
            word = words[at]
            states = {t for s in states for key in (word, _ANY) for t in self.steps[s].get(key, ())}
            if not states:
                return None
            if states & self.final:
                return at + 1
        return None


def compile_template(label: str, template: str) -> Automaton:
    """Thompson's construction, then silent steps are closed over. A template must begin with a mandatory word."""
    moves: list[dict[bytes, set[int]]] = [{}]
    silent: list[set[int]] = [set()]
    opened: list[int] = []
    now = 0

    def step(word: bytes) -> int:
        moves.append({})
        silent.append(set())
        moves[now].setdefault(word, set()).add(len(moves) - 1)
        return len(moves) - 1

    for token in _MARKUP.finditer(template):
        if token[0] == "<<optional>>":
            opened.append(now)
        elif token[0] == "<<end>>":
            start = opened.pop()
            moves.append({})
            silent.append(set())
            silent[now].add(len(moves) - 1)
            silent[start].add(len(moves) - 1)
            now = len(moves) - 1
        elif token[1]:
            exits = [now] if int(token[1]) == 0 else []
            for i in range(1, int(token[2]) + 1):
                now = step(_ANY)
                if i >= int(token[1]):
                    exits.append(now)
            moves.append({})
            silent.append(set())
            now = len(moves) - 1
            for s in exits:
                silent[s].add(now)
        else:
            now = step(token[0].encode())
    if opened:
        raise ValueError(f"template {label} has an <<optional>> without <<end>>")

    def closure(states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in silent[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        return seen

    steps = []
    for s in range(len(moves)):
        own: dict[bytes, set[int]] = {}
        for t in closure({s}):
            for word, to in moves[t].items():
                own.setdefault(word, set()).update(to)
        steps.append({word: frozenset(to) for word, to in own.items()})
    final = frozenset(s for s in range(len(moves)) if now in closure({s}))
    if 0 in final or _ANY in steps[0]:
        raise ValueError(f"template {label} must begin with a mandatory word")
    return Automaton(label, steps, final, frozenset(steps[0]))


class Scanner:
    def __init__(self, base: dict[str, str], templates: dict[str, str]) -> None:
        self.base = [(tuple(phrase.encode().split()), label) for phrase, label in base.items()]
        self.automata = [compile_template(label, text) for label, text in templates.items()]
        self.weights = {label: mandatory(text) for label, text in templates.items()}
        starts = {p[0] for p, _ in self.base} | {w for a in self.automata for w in a.first}
        #: Only texts with one of these words need the automata.
        self.starts = re.compile(rb"(?<![^ ])(?:" + b"|".join(map(re.escape, sorted(starts))) + rb")(?![^ ])")
        self.first = starts

    def scan(self, text: bytes) -> tuple:
        folded = text.translate(_FOLD)
        words = folded.split()  # white space other than the space is folded, too
        n_base, places, base, found = 0, [], set(), set()
        if self.starts.search(folded):
            for at, word in enumerate(words):
                if word not in self.first:
                    continue
                for phrase, label in self.base:
                    if word == phrase[0] and tuple(words[at : at + len(phrase)]) == phrase:
                        n_base += 1
                        places.append(at)
                        base.add(label)
                for automaton in self.automata:
                    if word in automaton.first and automaton.label not in found and automaton.accepts_at(words, at):
                        found.add(automaton.label)
        labels = base | found
        ends = (places[0], places[-1]) if places else (None, None)
        return len(words), n_base, *ends, ",".join(sorted(base)), ",".join(sorted(labels)), self.share(base, found, len(words))

    def share(self, base: set[str], found: set[str], n_words: int) -> float:
        """Words of the phrases and the mandatory wording found, each once, of all words; at most 1."""
        wording = sum(len(p) for p, label in self.base if label in base) + sum(self.weights[label] for label in found)
        return min(1.0, wording / n_words) if n_words else 0.0


def scanned(docs: DataFrame, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base (places of base phrases), first_word and last_word (the first and last such place;
    null if there is none), base_labels, labels (with the templates'; both distinct, sorted, joined by commas)
    and score: how much of the text is license wording, the words of the base phrases and the mandatory words of the templates
    found, each counted once, over all words, 1 at most.

    Null texts are empty: no words, no labels. One row for each row of ``docs``; extra columns are ignored.
    """
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, templates)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        for batch in batches:
            rows = list(zip(*map(scanner.scan, texts_of(batch)), strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, k) for x, k in zip(rows, kinds, strict=True)]], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(scan, schema)


def _as_regex(template: str) -> str:
    """The template as a regular expression over words that are each followed by one space."""
    out = []
    for token in _MARKUP.finditer(template):
        if token[0] == "<<optional>>":
            out.append("(?:")
        elif token[0] == "<<end>>":
            out.append(")?")
        elif token[1]:
            out.append(f"(?:[^ ]+ ){{{token[1]},{token[2]}}}")
        else:
            out.append(f"{token[0]} ")
    return " " + "".join(out)


def oracle_sql() -> str:
    weights = [(label, mandatory(t)) for label, t in TEMPLATES.items()]
    wording = " + ".join(f"CASE WHEN list_contains({side}, '{label}') THEN {n} ELSE 0 END" for side, label, n in (*[("b", label, len(p.split())) for p, label in BASE.items()], *[("f", label, n) for label, n in weights]))
    found = [f"CASE WHEN regexp_matches(t, '{_as_regex(template)}') THEN '{label}' END" for label, template in TEMPLATES.items()]
    places = " UNION ALL ".join(
        f"SELECT r, i - 1 AS pos, '{label}' AS label FROM words WHERE list_slice(w, i, i + {len(phrase.split()) - 1}) = {phrase.split()!r}" for phrase, label in BASE.items()
    )
    return f"""
WITH folded AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
texts AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS t FROM folded),
words AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM folded),
places AS ({places}),
base AS (SELECT r, count(*)::BIGINT AS n_base, min(pos)::BIGINT AS first_word, max(pos)::BIGINT AS last_word, list_sort(list_distinct(list(label))) AS b FROM places GROUP BY r),
joined AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(b, []) AS b,
    list_filter([{", ".join(found)}], lambda x: x IS NOT NULL) AS f FROM texts LEFT JOIN base USING (r)),
labelled AS (SELECT *, list_sort(list_distinct(list_concat(b, f))) AS l FROM joined)
SELECT doc_id, n_words, n_base, first_word, last_word, array_to_string(b, ',') AS base_labels, array_to_string(l, ',') AS labels, CASE WHEN n_words > 0 THEN least(1.0::DOUBLE, ({wording})::DOUBLE / n_words) ELSE 0.0::DOUBLE END AS score FROM labelled
"""
