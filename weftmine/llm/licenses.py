"""License scans: licence templates as token automata over whole texts.

A template is plain words with ``<<opt ...>>`` regions, whose words may be left out, and ``<<var n>>``
regions, which stand for up to n words of any kind; optional regions may hold others of both kinds. A text has the template's label where the
template's mandatory words follow one another exactly.

Defined results: a null or empty text has no words, no labels and score 0; an empty table gives no rows; repeated
rows each get their own; a null doc_id stays null; other columns of the input are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

# The phrases and labels of the contract.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_DISCLAIMER = "this software is provided by <<var 8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<var 8>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_CLAUSES = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met <<opt 1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer <<opt 2>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors <<opt or copyright holders>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_FSF = "<<opt as published by the free software foundation>> <<opt either>> version <<var 2>> of the license <<opt <<opt or>> at your option any later version>>"

# Public licence notices and texts as templates.
TEMPLATES = {
    "mit-notice": "<<opt this work is>> <<opt this software is>> released under the mit license",
    "mit-holder": "copyright c <<var 8>> licensed under the mit license",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice <<opt including the next paragraph>> shall be included in all copies or substantial portions of the software " + _AS_IS,
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and <<var 6>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <<var 6>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "bsd-2-clause-text": f"{_CLAUSES} {_DISCLAIMER}",
    "bsd-3-clause-text": f"{_CLAUSES} <<opt 3>> neither the name of <<var 8>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_DISCLAIMER}",
    "unlicense-text": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law " + _AS_IS,
    "apache-2.0": "licensed under the apache license version 2 0 <<opt the license>>",
    "apache-2.0-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at <<opt <<opt http>> <<opt https>> www apache org licenses license 2 0>> unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl-2.0": "licensed under the gnu general public license <<opt as published by the free software foundation>> version 2 <<opt or any later version>>",
    "gpl-3.0": "licensed under the gnu general public license <<opt as published by the free software foundation>> version 3 <<opt or any later version>>",
    "gpl-notice": f"under the terms of the gnu general public license {_FSF}",
    "lgpl-notice": f"under the terms of the gnu lesser general public license {_FSF}",
    "agpl-notice": f"under the terms of the gnu affero general public license {_FSF}",
    "mpl-2.0-notice": "this source code form is subject to the terms of the mozilla public license v 2 0 <<opt if a copy of the mpl was not distributed with this file you can obtain one at <<opt https>> <<opt http>> mozilla org mpl 2 0>>",
    "cc0-notice": "to the extent possible under law <<var 12>> has waived all copyright and related or neighboring rights to",
    "cc-by-4.0": "licensed under <<opt a>> <<opt the>> cc by 4 0 <<opt international>> <<opt license>>",
    "cc-by-nc-4.0": "licensed under <<opt a>> <<opt the>> cc by nc 4 0 <<opt international>> <<opt license>>",
    "cc-by-sa-4.0": "licensed under <<opt a>> <<opt the>> cc by sa 4 0 <<opt international>> <<opt license>>",
    "creative-commons-by": "licensed under <<opt a>> <<opt the>> creative commons attribution 4 0 <<opt international <<opt <<opt public>> license>>>>",
    "creative-commons-by-nc": "licensed under <<opt a>> <<opt the>> creative commons attribution noncommercial 4 0 <<opt international <<opt <<opt public>> license>>>>",
    "creative-commons-by-sa": "licensed under <<opt a>> <<opt the>> creative commons attribution sharealike 4 0 <<opt international <<opt <<opt public>> license>>>>",
}

_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """The text's words, A-Z in lower case."""
    return (text or "").encode().lower().translate(_WORDS).split()


def parsed(template: str) -> list:
    """The template's parts in order: a word, ("var", n) or ("opt", parts)."""
    stack: list[list] = [[]]
    tokens = iter(re.findall(r"<<opt|<<var \d+>>|>>|[^\s<>]+", template))
    for token in tokens:
        if token == "<<opt":
            stack.append([])
        elif token == ">>":
            inside = stack.pop()
            stack[-1].append(("opt", inside))
        elif token.startswith("<<var"):
            stack[-1].append(("var", int(token[6:-2])))
        else:
            stack[-1].append(token)
    (parts,) = stack
    return parts


class Automata:
    """All templates in one automaton. A state is a place in a template; a set of states is one integer's bits."""

    def __init__(self, templates: Mapping[str, str]):
        self.on: dict[bytes, int] = {}  # the states that a word leads on from
        self.free = 0  # those that any word leads on from
        self.labels: dict[int, str] = {}
        self.closure: list[int] = []  # the states reached from each without a word, itself included
        self.share: list[float] = []  # of the template's mandatory words, those before the state
        start, at = 0, 0
        for label, template in templates.items():
            states: list[tuple[bytes | None, bool]] = []
            skips: dict[int, list[int]] = {}

            def lay(parts: list, must: bool, states=states, skips=skips) -> None:
                for part in parts:
                    begin = len(states)
                    if isinstance(part, str):
                        states.append((part.encode(), must))
                    elif part[0] == "opt":
                        lay(part[1], False)
                        skips.setdefault(begin, []).append(len(states))
                    else:
                        for k in range(part[1]):
                            states.append((None, False))
                            skips.setdefault(begin + k, []).append(begin + part[1])

            lay(parsed(template), True)
            mandatory, seen = sum(m for _, m in states), 0
            reach = [1 << (at + i) for i in range(len(states) + 1)]
            for a in sorted(skips, reverse=True):
                for b in skips[a]:
                    reach[a] |= reach[b]
            for i, (word, must) in enumerate(states):
                self.share.append(seen / mandatory)
                seen += must
                if word is None:
                    self.free |= 1 << (at + i)
                else:
                    self.on[word] = self.on.get(word, 0) | 1 << (at + i)
            self.share.append(1.0)
            self.closure += reach
            self.labels[at + len(states)] = label
            start |= reach[0]
            at += len(states) + 1
        self.start = start
        self.accept = sum(1 << k for k in self.labels)
        self.first = {w for w, m in self.on.items() if m & start}

    def scan(self, tokens: Sequence[bytes]) -> tuple[set[str], float]:
        """The labels of templates found, and the largest part of a template's mandatory words found in place."""
        found: set[str] = set()
        if self.first.isdisjoint(tokens) and not self.start & self.free:
            return found, 0.0
        best, now, on, free, start, first, closure = 0.0, 0, self.on, self.free, self.start, self.first, self.closure
        for w in tokens:
            if not now and w not in first:
                continue
            moved = ((now | start) & (on.get(w, 0) | free)) << 1
            now = 0
            while moved:
                low = moved & -moved
                moved ^= low
                k = low.bit_length() - 1
                now |= closure[k]
                best = max(best, self.share[k])
            if hit := now & self.accept:
                found |= {label for k, label in self.labels.items() if hit >> k & 1}
        return found, 1.0 if found else best


def scan(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is 1 where a template is found, else the largest part of a template's mandatory words that stand in
    place, 0.5 at least where a phrase is found.
    """
    split = {tuple(p.encode().split()): label for p, label in phrases.items()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = Automata(templates)
        begins: dict[bytes, list] = {}
        for p, label in split.items():
            begins.setdefault(p[0], []).append((list(p), label))
        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = words(text.as_py())
                places, base = [], set()
                for w, starts in begins.items():
                    at = -1
                    for _ in range(tokens.count(w)):
                        at = tokens.index(w, at + 1)
                        for p, label in starts:
                            if tokens[at : at + len(p)] == p:
                                places.append(at)
                                base.add(label)
                found, score = automata.scan(tokens)
                out.append((doc_id, len(tokens), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | found)), max(score, 0.5 if base else 0.0)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema, strict=True)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
