"""License scans: template markup compiled to token automata.

A template is words with two kinds of regions: ``[...]`` may be left out (regions
may lie within one another), ``{n}`` stands for one to n words of any kind
(``{0-n}``: also none). It is compiled to an automaton over words, whose states
are positions in the template; a text is accepted where all mandatory words stand
in order and nothing but optional and replaceable regions lies between them.
Every occurrence is found: each place of one of the template's first words starts
a run, and a run is bounded by the template's longest form, so the work is
linear in the text. A template must have a mandatory word (else it would accept
the empty text); its longest mandatory wording is looked for before anything else.

Words are those of the lower-cased (A-Z only) UTF-8 bytes: runs of digits,
letters a-z and bytes above 0x7F.

Defined results: null text is empty and has no words; empty texts have the empty
label lists, null places and score 0; places of base phrases are counted with
overlaps; of a template's places that overlap the first counts, at its longest;
rows that repeat get equal answers; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from colloquy.llm.common import ship, table

# Phrases whose consecutive words give the base labels.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]
# Wording of public licenses and license notices, with what authors fill in or leave out marked.
TEMPLATES = [
    ("[this work is] {0-2} released under the mit license", "mit"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice [including the next paragraph] shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability "
        "whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        "mit",
    ),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
        "the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and {1-8} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall {1-8} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "isc",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "[1] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "[2] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
        "in the documentation and or other materials provided with the distribution "
        "[[3] neither the name of {1-12} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission] "
        "this software is provided by {1-8} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall {1-8} be liable for any direct indirect incidental special exemplary or consequential damages "
        "including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
        "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
        "arising in any way out of the use of this software even if advised of the possibility of such damage",
        "bsd",
    ),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "[1] the origin of this software must not be misrepresented you must not claim that you wrote the original software "
        "if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
        "[2] altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
        "[3] this notice may not be removed or altered from any source distribution",
        "zlib",
    ),
    (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software "
        "to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software "
        "and to permit third parties to whom the software is furnished to do so all subject to the following",
        "bsl-1",
    ),
    (
        "this is free and unencumbered software released into the public domain "
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means",
        "unlicense",
    ),
    ("licensed under [the] apache license [version] 2 [0]", "apache-2"),
    (
        "licensed under the apache license version 2 0 the license you may not use {1-3} except in compliance with the license "
        "you may obtain a copy of the license at [http] [https] [www] apache org licenses license 2 0 [txt] [html] "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        "apache-2",
    ),
    ("licensed under the apache license version 2 0 the license you may not use {1-3} except in compliance with the license", "apache-2"),
    ("licensed under [the] [creative commons] cc by nc {1} 0", "cc-by-nc"),
    ("licensed under [a] [the] creative commons attribution noncommercial {1} 0 [international] [unported] license", "cc-by-nc"),
    ("licensed under [the] gnu general public license [as published by the free software foundation] [either] version 3", "gpl-3"),
    ("licensed under [the] gnu general public license [as published by the free software foundation] [either] version 2", "gpl-2"),
    (
        "{1-4} is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or [at your option] any later version",
        "gpl-3",
    ),
    (
        "{1-4} is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 2 of the license or [at your option] any later version",
        "gpl-2",
    ),
    (
        "{1-4} is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation "
        "either version {1} [1] of the license or [at your option] any later version",
        "lgpl",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 "
        "if a copy of the mpl was not distributed with this file you can obtain one at [http] [https] mozilla org mpl 2 0",
        "mpl-2",
    ),
]
WORD = bytes(c if chr(c).isdigit() or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, spans array<struct<label:string,start:long,length:long>>, covered long"


class Automaton:
    """Positions of one template; ``reach`` tells what positions are at hand without a word."""

    def __init__(self, markup: str, label: str):
        self.label, self.nodes = label, []  # a word, or None for any
        skips: list[tuple[int, int]] = []
        opened: list[int] = []
        for m in re.finditer(r"(\[)|(\])|\{(?:(\d+)-)?(\d+)\}|([^\s\[\]{}]+)", markup):
            begin, end, low, high, word = m.groups()
            at = len(self.nodes)
            if begin:
                opened.append(at)
            elif end:
                skips.append((opened.pop(), at))
            elif high:
                self.nodes += [None] * int(high)
                skips += [(at + k, len(self.nodes)) for k in range(1 if low is None else int(low), int(high))]
            else:
                self.nodes.append(word.encode())
        if opened:
            raise ValueError(f"unclosed region in a template of {label}")
        n = len(self.nodes)
        after: dict[int, set[int]] = {}
        for a, b in skips:
            after.setdefault(a, set()).add(b)
        self.reach: list[set[int]] = [set()] * (n + 1)
        for i in range(n, -1, -1):
            self.reach[i] = {i}.union(*(self.reach[j] for j in after.get(i, ())))
        free = {i for a, b in skips for i in range(a, b)} | {i for i, w in enumerate(self.nodes) if w is None}
        runs = [[]]
        for i, w in enumerate(self.nodes):
            if i in free:
                runs.append([])
            elif i in after:  # a skip may begin here although the word is mandatory
                runs.append([w])
            else:
                runs[-1].append(w)
        if not any(runs):
            raise ValueError(f"a template of {label} has no mandatory word")
        #: The longest wording that every accepted text has.
        self.anchor = b" " + b" ".join(max(runs, key=lambda r: sum(map(len, r)))) + b" "
        self.starts = {self.nodes[i] for i in self.reach[0] if i < n and self.nodes[i] is not None}
        self.any_start = any(i < n and self.nodes[i] is None for i in self.reach[0])

    def match(self, words: list[bytes], at: int) -> int:
        """Length of the longest accepted run of words from ``at``; 0 if none."""
        n, live, best = len(self.nodes), self.reach[0], 0
        for k in range(at, min(len(words), at + n)):
            w, after = words[k], set()
            for i in live:
                if i < n and self.nodes[i] in (None, w):
                    after |= self.reach[i + 1]
            if not after:
                break
            live = after
            if n in live:
                best = k + 1 - at
        return best

    def find(self, words: list[bytes], padded: bytes) -> list[tuple[int, int]]:
        """(start, length) of every place that isn't inside the one before."""
        if self.anchor not in padded:
            return []
        out, end = [], 0
        for i, w in enumerate(words):
            if i >= end and (self.any_start or w in self.starts) and (n := self.match(words, i)):
                out.append((i, n))
                end = i + n
        return out


def compiled(templates: list[tuple[str, str]]) -> list[Automaton]:
    return [Automaton(markup, label) for markup, label in templates]


def scan(text: str | None, automata: list[Automaton], base: list[tuple[list[bytes], str]]) -> tuple:
    words = (text or "").encode("utf-8", "surrogatepass").lower().translate(WORD).split()
    padded = b" " + b" ".join(words) + b" "
    spans, places, base_labels, labels = [], [], set(), set()
    for phrase, label in base:
        needle, at, seen, word = b" " + b" ".join(phrase) + b" ", -1, 0, 0
        while (at := padded.find(needle, at + 1)) >= 0:
            word += padded.count(b" ", seen, at)  # words before this place, from those before the last
            seen = at
            places.append(word)
            spans.append((label, places[-1], len(phrase)))
            base_labels.add(label)
    for a in automata:
        for start, n in a.find(words, padded):
            spans.append((a.label, start, n))
            labels.add(a.label)
    covered, end = 0, 0
    for start, stop in sorted((s, s + n) for _, s, n in spans):
        covered += max(0, stop - max(start, end))
        end = max(end, stop)
    return len(words), len(places), min(places, default=None), max(places, default=None), sorted(base_labels), sorted(labels | base_labels), spans, covered


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, base: list[tuple[str, str]] = BASE) -> DataFrame:
    """Labels, places and spans of every whole text; one narrow map, no shuffle."""
    ship(docs.sparkSession)
    phrases = [(p.encode().split(), label) for p, label in base]
    kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("length", pa.int64())])), pa.int64()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "spans", "covered"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = compiled(templates)
        for b in batches:
            texts, rows = b.column("text"), []
            for t in texts:
                *most, spans, covered = scan(t.as_py(), automata, phrases)
                rows.append((*most, [{"label": x, "start": s, "length": n} for x, s, n in spans], covered))
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", *names])

    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "CAST(text AS string) AS text").mapInArrow(task, RESULT)


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).selectExpr(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        "array_join(base_labels, ',') AS base_labels", "array_join(labels, ',') AS labels",
        "CASE WHEN n_words = 0 THEN 0D ELSE covered / n_words END AS score",
    )
