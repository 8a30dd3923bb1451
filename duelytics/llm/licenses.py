"""License scan by templates with optional and replaceable regions.

A template is written as words with markup: `[[ ... ]]` may be missing, `{{n}}` stands for up to n
words of any kind. It is compiled into an automaton over words; a place is accepted when the
mandatory wording matches exactly. A plain phrase is a template without markup.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

# The phrases every scan reports, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Wording of common notices, lower-cased, without punctuation.
TEMPLATES = {
    "mit-notice": "[[released]] [[distributed]] [[licensed]] under the [[terms of the]] [[expat]] mit license",
    "mit-text": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and"
        " associated documentation files the {{4}} to deal in the {{4}} without restriction including without"
        " limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the"
        " {{4}} and to permit persons to whom the {{4}} is furnished to do so subject to the following conditions"
        " the above copyright notice and this permission notice [[including the next paragraph]] shall be"
        " included in all copies or substantial portions of the {{4}} the {{4}} is provided as is without warranty of"
        " any kind express or implied including but not limited to the warranties of merchantability fitness for a"
        " particular purpose and noninfringement in no event shall the {{8}} be liable for any claim damages or"
        " other liability whether in an action of contract tort or otherwise arising from out of or in connection"
        " with the {{4}} or the use or other dealings in the {{1}}"
    ),
    "apache-2-notice": "[[licensed]] under the apache license [[version]] 2 [[0]]",
    "apache-2-header-notice": (
        "licensed under the apache license version 2 0 the license you may not use this [[work or]] file except"
        " in compliance with the license you may obtain a copy of the license at {{12}} unless required by"
        " applicable law or agreed to in writing software distributed under the license is distributed on an as"
        " is basis without warranties or conditions of any kind either express or implied see"
        " the license for the specific language governing permissions and limitations under the license"
    ),
    "cc-by": "[[licensed]] [[under]] [[a]] [[the]] creative commons attribution [[{{2}}]] [[international]] license",
    "cc-by-nc-notice": "cc by nc [[nd]] [[sa]] [[{{2}} international]]",
    "bsd-text": (
        "redistribution and use in source and binary forms with or without modification are permitted provided"
        " that the following conditions are met [[1]] redistributions of source code must retain the above"
        " copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary"
        " form must reproduce the above copyright notice this list of conditions and the following disclaimer in"
        " the documentation and or other materials provided with the distribution [[ [[3]] neither the name of"
        " {{10}} nor the names of [[its]] [[their]] contributors may be used to endorse or promote products derived"
        " from this software without specific prior written permission ]] this software is provided by {{8}} as is"
        " and any express or implied warranties including but not limited to the implied warranties of"
        " merchantability and fitness for a particular purpose are disclaimed in no event shall {{8}} be liable for"
        " any direct indirect incidental special exemplary or consequential damages including but not limited to"
        " procurement of substitute goods or services loss of use data or profits or business interruption however"
        " caused and on any theory of liability whether in contract strict liability or tort including negligence"
        " or otherwise arising in any way out of the use of this software even if advised of the possibility of"
        " such damage"
    ),
    "gpl-notice": (
        "under the terms of the gnu [[lesser]] [[affero]] general public license [[as published by the free"
        " software foundation]] [[either]] [[version {{2}}]]"
    ),
    "mpl-2-notice": "subject to the terms of the mozilla public license [[v]] [[version]] 2 [[0]]",
}

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_MARKUP = re.compile(r"\[\[|\]\]|\{\{\d+\}\}|[^\s\[\]{}]+")
ANY = b""  # no word is empty


class Automaton(NamedTuple):
    """States are numbered; `steps[s]` is [(word or ANY, next)], closed over regions that may be missing."""

    steps: list[list[tuple[bytes, int]]]
    final: frozenset[int]
    first: frozenset[bytes]

    def longest(self, words: list[bytes], at: int) -> int:
        """End of the longest accepted run of words that begins at `at`, or -1."""
        states, end = {0}, -1
        while states and at < len(words):
            word, following = words[at], set()
            for state in states:
                for wanted, target in self.steps[state]:
                    if wanted == word or wanted == ANY:
                        following.add(target)
            at, states = at + 1, following
            if states & self.final:
                end = at
        return end


def compile_template(template: str) -> Automaton:
    """Thompson's construction; `{{n}}` is n words that may each be missing."""
    edges: list[list[tuple[bytes, int]]] = [[]]
    empty: list[list[int]] = [[]]
    opened: list[int] = []

    def state() -> int:
        edges.append([])
        empty.append([])
        return len(edges) - 1

    now = 0
    for part in _MARKUP.findall(template):
        if part == "[[":
            opened.append(now)
            inner = state()
            empty[now].append(inner)
            now = inner
        elif part == "]]":
            after = state()
            empty[now].append(after)
            empty[opened.pop()].append(after)
            now = after
        elif part.startswith("{{"):
            for _ in range(int(part[2:-2])):
                after = state()
                edges[now].append((ANY, after))
                empty[now].append(after)
                now = after
        else:
            after = state()
            edges[now].append((part.encode(), after))
            now = after

    def closure(start: int) -> set[int]:
        seen, open_ = {start}, [start]
        while open_:
            for other in empty[open_.pop()]:
                if other not in seen:
                    seen.add(other)
                    open_.append(other)
        return seen

    reach = [closure(s) for s in range(len(edges))]
    steps = [[edge for s in sorted(r) for edge in edges[s]] for r in reach]
    final = frozenset(s for s, r in enumerate(reach) if now in r)
    first = frozenset(word for word, _ in steps[0])
    if 0 in final or ANY in first:
        raise ValueError("a template begins with a mandatory or optional word and isn't empty")
    return Automaton(steps, final, first)


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        compiled = [(compile_template(text), label, True) for text, label in phrases.items()]
        compiled += [(compile_template(text), label, False) for label, text in templates.items()]
        self.starting: dict[bytes, list[tuple[Automaton, str, bool]]] = {}
        for entry in compiled:
            for word in entry[0].first:
                self.starting.setdefault(word, []).append(entry)

    def scan(self, text: str | None) -> tuple:
        words = WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())
        starting = self.starting
        base, labels, base_labels, covered = [], set(), set(), set()
        for at in [i for i, word in enumerate(words) if word in starting]:
            for automaton, label, is_base in starting[words[at]]:
                end = automaton.longest(words, at)
                if end > 0:
                    labels.add(label)
                    covered.update(range(at, end))
                    if is_base:
                        base.append(at)
                        base_labels.add(label)
        return (len(words), len(base), min(base, default=None), max(base, default=None),
                ",".join(sorted(base_labels)), ",".join(sorted(labels)),
                len(covered) / len(words) if words else 0.0)


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string,"
          " labels string, score double")


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """One row for every row of `docs`; `score` is the share of its words that accepted places cover.

    Null and empty texts have no words, no places and score 0; first_word and last_word are null
    where no phrase stands. Equal rows give equal rows, an empty table none; other columns are not
    looked at. Memory is that of one text and its words.
    """

    def work(batches):
        scanner = Scanner(phrases, templates)
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = [part.split()[0] for part in SCHEMA.split(", ")]
        for batch in batches:
            found = [scanner.scan(text.as_py()) for text in batch.column("text")]
            columns = zip(*found) if found else [[] for _ in types]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))], names=names)

    return docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text").mapInArrow(work, SCHEMA)
