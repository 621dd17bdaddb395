"""License scans through a positional index of rare licence words.

Every template is a licence text or notice with key phrases that must occur.
Counts over all documents give each template word its IDF.  The index holds each
template word's positions in each template.  Of a document's licence words, those
of the highest IDF are looked up for each template whose key words it holds; their
postings are intersected by relative position (place in the document less place
in the template), and where enough agree the key phrases are verified word by word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import give_back

# Words are runs of 0-9, a-z and non-ASCII characters, after A-Z became a-z.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


@dataclass(frozen=True)
class Template:
    label: str
    notice: str
    keys: tuple[str, ...]  # parts of the notice that must occur, word by word


# Phrases that always give a label.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Texts and notices of public licences, without signs.
MIT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software"
    " to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense"
    " and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
    " the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"
)
BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    " redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in"
    " binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other"
    " materials provided with the distribution"
)
ISC = (
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above"
    " copyright notice and this permission notice appear in all copies"
)
ZLIB = (
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising"
    " from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to"
    " alter it and redistribute it freely subject to the following restrictions"
)
APACHE = (
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy"
    " of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed"
    " under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
)
FREE_SOFTWARE = (
    "this {0} is free software you can redistribute it and or modify it under the terms of the gnu {1} public license as published by the free software"
    " foundation either version {2} of the license or at your option any later version"
)
UNLICENSE = (
    "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this"
    " software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"
)
MPL = (
    "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can"
    " obtain one at http mozilla org mpl 2 0"
)
TEMPLATES = (
    Template("mit", MIT, ("hereby granted free of charge", "without restriction")),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("apache", APACHE, ("apache license version", "in compliance with the license")),
    Template("apache", "licensed under the apache license version 2 0", ("apache license",)),
    Template("gpl", FREE_SOFTWARE.format("program", "general", "3"), ("redistribute it and or modify", "gnu general public license")),
    Template("gpl", "this work is licensed under the gnu general public license version 3", ("general public license",)),
    Template("lgpl", FREE_SOFTWARE.format("library", "lesser general", "2 1"), ("gnu lesser general public license",)),
    Template("lgpl", "licensed under the gnu lesser general public license version 3", ("lesser general public license",)),
    Template("agpl", FREE_SOFTWARE.format("program", "affero general", "3"), ("gnu affero general public license",)),
    Template("agpl", "licensed under the gnu affero general public license version 3", ("affero general public license",)),
    Template("bsd", BSD, ("redistribution and use in source and binary forms", "must retain the above copyright notice")),
    Template("bsd", "licensed under the bsd license", ("bsd license",)),
    Template("isc", ISC, ("permission to use copy modify", "this permission notice appear in all copies")),
    Template("zlib", ZLIB, ("permission is granted to anyone to use this software", "alter it and redistribute it freely")),
    Template("unlicense", UNLICENSE, ("free and unencumbered software", "public domain")),
    Template("mpl", MPL, ("mozilla public license", "a copy of the mpl was not distributed")),
    Template("mpl", "subject to the terms of the mozilla public license version 2 0", ("mozilla public license",)),
    Template("epl", "made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    Template("cc0", "licensed under cc0 1 0 universal", ("cc0 1 0",)),
    Template("cc0", "creative commons zero public domain dedication", ("creative commons zero",)),
    Template("cc-by", "licensed under cc by 4 0", ("cc by 4",)),
    Template("cc-by", "licensed under the creative commons attribution 4 0 international license", ("creative commons attribution 4",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-sa", "licensed under the creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nc", "licensed under the creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Template("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
)

# Parameters: of a document's licence words so many of the highest IDF are looked up for each
# template; words an occurrence may be shifted by in all; the share of these words' IDF that has
# to agree on a place, and the score (the share of the notice's words, by IDF, that stand there)
# from which a template's label counts.
RARE_WORDS, SLACK, AGREEING, LEAST_SCORE = 8, 3, 0.5, 0.5


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split() if text else []


def vocabulary(templates: tuple[Template, ...]) -> frozenset[bytes]:
    return frozenset(w for t in templates for w in words_of(t.notice))


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...]) -> tuple[int, dict[bytes, int]]:
    """Number of documents, and how many of them hold each template word.

    Every task adds up its own counts, so the driver gets one row for each
    template word, whatever the number of documents."""
    known = vocabulary(templates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = dict.fromkeys(known, 0)
        n = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                for w in known.intersection(words_of(text)):
                    found[w] += 1
        give_back()
        words = [w.decode() for w in found] + [""]
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array([*found.values(), n], pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").sum("n").collect()
    totals = {r[0].encode(): r[1] for r in rows}
    return totals.pop(b"", 0), {w: totals.get(w, 0) for w in known}


class Index:
    """Positions of each template word in each template."""

    def __init__(self, templates: tuple[Template, ...], n_docs: int, frequency: dict[bytes, int]):
        self.idf = {w: math.log((n_docs + 1) / (frequency.get(w, 0) + 1)) + 1e-6 for w in vocabulary(templates)}
        self.labels = [t.label for t in templates]
        self.notices = [words_of(t.notice) for t in templates]
        self.keys = [[words_of(k) for k in t.keys] for t in templates]
        self.starts = [[self._start(n, k) for k in ks] for n, ks in zip(self.notices, self.keys, strict=True)]
        self.weights = [sum(self.idf[w] for w in n) for n in self.notices]
        #: Word -> template -> its positions there.
        self.postings: dict[bytes, dict[int, list[int]]] = {}
        for t, notice in enumerate(self.notices):
            for place, w in enumerate(notice):
                self.postings.setdefault(w, {}).setdefault(t, []).append(place)
        #: Templates filed under the word of their key phrases with the highest IDF.
        self.filed: dict[bytes, list[int]] = {}
        for t, keys in enumerate(self.keys):
            self.filed.setdefault(max((w for k in keys for w in k), key=lambda w: (self.idf[w], w)), []).append(t)

    @staticmethod
    def _start(notice: list[bytes], key: list[bytes]) -> int:
        for i in range(len(notice)):
            if notice[i : i + len(key)] == key:
                return i
        raise ValueError(f"a key phrase is not part of its notice: {key}")

    def scan(self, words: list[bytes], present: frozenset | set) -> dict[str, float]:
        """label -> best score of its templates."""
        best: dict[str, float] = {}
        at: dict[bytes, list[int]] = {}
        for rare in present & self.filed.keys():
            for t in self.filed[rare]:
                if not all(present.issuperset(k) for k in self.keys[t]):
                    continue
                if not at:  # places of all licence words, once for a document that may hold a licence
                    for i, w in enumerate(words):
                        if w in self.postings:
                            at.setdefault(w, []).append(i)
                for origin in self._places(t, at):
                    if self._verified(t, origin, words):
                        best[self.labels[t]] = max(best.get(self.labels[t], 0.0), self._score(t, origin, words))
        return best

    def _places(self, t: int, at: dict[bytes, list[int]]) -> list[int]:
        """Where the notice may begin: relative positions on which the document's
        rarest words of it agree, give or take SLACK."""
        held = sorted({w for w in self.notices[t] if w in at}, key=lambda w: (-self.idf[w], w))[:RARE_WORDS]
        votes: dict[int, set[bytes]] = {}
        for w in held:
            for place in self.postings[w][t]:
                for i in at[w]:
                    votes.setdefault(i - place, set()).add(w)
        need = AGREEING * sum(self.idf[w] for w in held)
        found = []
        for origin in sorted(votes):
            near = set().union(*(votes.get(origin + d, ()) for d in range(-SLACK, SLACK + 1)))
            if sum(self.idf[w] for w in near) >= need:
                found.append(origin)
        return found

    def _verified(self, t: int, origin: int, words: list[bytes]) -> bool:
        for key, start in zip(self.keys[t], self.starts[t], strict=True):
            first = range(max(0, origin + start - SLACK), max(0, origin + start + SLACK + 1))
            if not any(words[i : i + len(key)] == key for i in first):
                return False
        return True

    def _score(self, t: int, origin: int, words: list[bytes]) -> float:
        got = 0.0
        for place, w in enumerate(self.notices[t]):
            low = max(0, origin + place - SLACK)
            if w in words[low : max(0, origin + place + SLACK + 1)]:
                got += self.idf[w]
        return got / self.weights[t]


def base_places(words: list[bytes], present: set) -> tuple[int, int | None, int | None, set[str]]:
    """Number of places of the base phrases, first and last start, labels."""
    starts, labels = [], set()
    if b"license" in present:
        for phrase, label in BASE_PHRASES.items():
            parts = words_of(phrase)
            if not present.issuperset(parts):
                continue
            at = -1
            for _ in range(words.count(parts[-1])):
                at = words.index(parts[-1], at + 1)
                first = at - len(parts) + 1
                if first >= 0 and words[first : at + 1] == parts:
                    starts.append(first)
                    labels.add(label)
    return len(starts), min(starts, default=None), max(starts, default=None), labels


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and
    score for each row of ``docs``.

    Null and empty texts have no words: counts of 0, null places, empty labels
    and score 0.  The score is the best template's share of matched IDF, 0.5
    where only a base phrase matched, else 0.  Repeated rows are scanned alike;
    texts of any length are read whole; an empty table gives no rows; other columns
    are ignored.
    """
    n_docs, frequency = document_frequencies(docs, templates)
    index = Index(templates, n_docs, frequency)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                present = set(words)
                n_base, first, last, base = base_places(words, present)
                found = {k: v for k, v in index.scan(words, present).items() if v >= LEAST_SCORE}
                score = max(found.values(), default=0.5 if base else 0.0)
                rows.append((len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | found.keys())), min(1.0, score)))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)
        give_back()

    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    )
