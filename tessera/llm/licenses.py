"""License scans by a positional index of rare words.

Words are the runs of letters and digits (every non-ASCII character counts as one) after lower-casing A-Z. The
template texts are indexed by (word -> template, position). Only templates whose mandatory phrases have all of their
words in the file can match; every word of those looks up the postings, and postings that agree on the relative
position, up to a few words put in or left out, vote for a template at that place. A template counts when its mandatory
phrases stand there and the words in place hold enough of its inverse document frequency, taken over the whole corpus.
Base phrases are found everywhere, whatever the votes say.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases whose places are all reported, with their labels (fixed values).
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Label -> (notice or full text, mandatory phrases); the texts of published licences are fixed values.
TEMPLATES = {
    "gpl-notice": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["free software", "gnu general public license"]),
    "gpl-licensed": ("licensed under the gnu general public license", ["licensed under", "gnu general public license"]),
    "lgpl": ("under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    "agpl": ("under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    "apache-2.0": ("licensed under the apache license version 2 0", ["apache license version 2 0"]),
    "mit-text": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    "mit-notice": ("released under the mit license", ["mit license"]),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify and or distribute"]),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    "cc-by-nc": ("licensed under cc by nc 4 0", ["cc by nc"]),
    "cc-by-sa": ("licensed under cc by sa 4 0", ["cc by sa"]),
    "cc-attribution": ("licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    "cc0": ("to the extent possible under law the author has waived all copyright and related or neighboring rights", ["waived all copyright"]),
    "unlicense": ("this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    "eclipse": ("made available under the terms of the eclipse public license", ["eclipse public license"]),
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        ["permission is hereby granted free of charge", "the software is provided as is"],
    ),
    "bsd-3-clause": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
        ["redistribution and use in source and binary forms", "may be used to endorse or promote products"],
    ),
    "isc-text": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        ["permission to use copy modify and or distribute", "disclaims all warranties with regard to this software"],
    ),
    "apache-2.0-header": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        ["you may not use this file except in compliance with the license", "governing permissions and limitations under the license"],
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software",
        ["permission is granted to anyone to use this software for any purpose", "the origin of this software must not be misrepresented"],
    ),
    "bsl-1.0": (
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software",
        ["obtaining a copy of the software and accompanying documentation covered by this license"],
    ),
    "wtfpl": (
        "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
        ["everyone is permitted to copy and distribute verbatim or modified copies"],
    ),
    "proprietary": ("all rights reserved no part of this publication may be reproduced without permission", ["all rights reserved"]),
}

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


@dataclass
class Index:
    """Postings of the templates and the idf of their words."""

    templates: dict[str, tuple[str, list[str]]] = field(default_factory=lambda: TEMPLATES)
    base: dict[str, str] = field(default_factory=lambda: BASE_PHRASES)
    idf: dict[bytes, float] = field(default_factory=dict)
    quorum: float = 0.5
    #: Words by which places of a template may differ, where words were put in or left out.
    slack: int = 8

    def __post_init__(self):
        self.text = {k: t.encode().split() for k, (t, _) in self.templates.items()}
        self.phrases = {k: [(self._at(self.text[k], p.encode().split()), p.encode().split()) for p in ps] for k, (_, ps) in self.templates.items()}
        self.postings = defaultdict(list)
        for k, ws in self.text.items():
            for i, w in enumerate(ws):
                self.postings[w].append((k, i))
        self.vocabulary = frozenset(self.postings)
        self.needed = {k: frozenset(w for _, q in ps for w in q) for k, ps in self.phrases.items()}
        self.base_words = [(p.encode().split(), label) for p, label in self.base.items()]
        # a cheap test that the text holds a phrase's words one after another, whatever stands between
        self.maybe = re.compile(b"|".join(rb"\s+".join(map(re.escape, p)) for p, _ in self.base_words))

    @staticmethod
    def _at(text: list[bytes], phrase: list[bytes]) -> int:
        return next(i for i in range(len(text)) if text[i : i + len(phrase)] == phrase)

    def places(self, ws: list[bytes]) -> list[tuple[int, str]]:
        """(word, label) of every place of a base phrase."""
        out = []
        for phrase, label in self.base_words:
            i, n = -1, len(phrase)
            try:
                while True:
                    i = ws.index(phrase[0], i + 1)
                    if ws[i : i + n] == phrase:
                        out.append((i, label))
            except ValueError:
                pass
        return out

    def matches(self, ws: list[bytes]) -> dict[str, float]:
        """Label -> share of the template's idf that stands in place, for templates whose phrases are verified."""
        idf = self.idf
        present = self.vocabulary.intersection(ws)
        possible = [k for k, need in self.needed.items() if need <= present]
        if not possible:
            return {}
        postings, votes = defaultdict(list), defaultdict(lambda: defaultdict(set))
        for k in possible:
            for p, w in enumerate(self.text[k]):
                postings[w].append((k, p))
        for i, w in enumerate(ws):
            if w in postings:
                for k, p in postings[w]:
                    votes[k][i - p].add(p)
        found: dict[str, float] = {}
        for k, at_of in votes.items():
            whole = sum(idf.get(w, 1.0) for w in self.text[k])
            # a phrase's first word fixes the places that are worth a look
            first, q = self.phrases[k][0]
            for at in [x for x, ps in at_of.items() if first in ps and ws[x + first : x + first + len(q)] == q]:
                near = [x for x in range(at - self.slack, at + self.slack + 1) if x in at_of]
                if all(any(p in at_of[x] and ws[x + p : x + p + len(r)] == r for x in near) for p, r in self.phrases[k]):
                    placed = set().union(*(at_of[x] for x in near))
                    got = sum(idf.get(self.text[k][p], 1.0) for p in placed)
                    if got >= self.quorum * whole:
                        found[k] = max(found.get(k, 0.0), min(1.0, got / whole))
        return found


def frequencies(docs: DataFrame, index: Index, text_col: str = "text") -> dict[bytes, float]:
    """idf of the templates' words over all documents: 1 + ln((n + 1) / (df + 1)), so more than 0; the vocabulary bounds what the driver gets."""
    vocabulary = index.vocabulary

    def run(batches):
        n, df = 0, Counter()
        for b in batches:
            for t in b.column(0):
                n += 1
                df.update(vocabulary.intersection(words(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(["", *(w.decode() for w in df)], pa.string()), pa.array([n, *df.values()], pa.int64())], names=["word", "n"])

    got = {r.word: r.n for r in docs.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    n = got.pop("", 0)
    return {w: 1 + math.log((n + 1) / (got.get(w.decode(), 0) + 1)) for w in vocabulary}


def scan(docs: DataFrame, index: Index | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null text counts as empty: no words, no places, empty label strings, score 0. Rows are handled one by one, so
    repeated ids give repeated rows. score is the best share of a template in place; a base phrase alone gives 0.5.
    """
    index = index or Index()
    index.idf = frequencies(docs, index, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kept = docs.select(id_col, text_col)

    def run(batches):
        own = shared.value
        for b in batches:
            rows = []
            for t in b.column(1):
                ws = words(t.as_py())
                at = own.places(ws)
                found = own.matches(ws)
                base = {label for _, label in at}
                rows.append((len(ws), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted(base)), ",".join(sorted(base | set(found))), max([0.5 * bool(at), *found.values()])))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[id_col, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return kept.mapInArrow(run, f"{id_col} {kept.schema[0].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
