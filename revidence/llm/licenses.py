"""Operator 12: licence scan by a positional index of rare licence words.

Templates (notices and licence texts) are indexed by word: template and position. A pass over the corpus counts in how many files each
licence word stands. A file that holds all words of a template's key phrases looks up its highest-IDF words of that template;
every occurrence votes for the place where the template would begin, and places that ``AGREE`` words agree on are verified: the key
phrases must stand there at their relative positions (give or take ``SLACK`` words), and the coverage is the share of the
template's words found at theirs. A notice is a template that must stand as it is: its rarest word is looked up, the postings of the others are
intersected at their relative positions, and every place counts.

Rows: null and empty texts have no words and no places. Texts are read whole; a very long one is one list of words in its task.
Repeated rows are scanned each. Overlapping places count each. Only doc_id and text are read. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revidence.llm.common import released

#: A word in UTF-8 bytes after lower-casing A-Z: digits, a-z and all that is not ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Highest-IDF words of a template that a file looks up, words that must agree on a place, words by which parts of a text may be shifted.
LOOK, AGREE, SLACK = 8, 3, 12
#: Share of a template's words that must be found at their places.
COVERAGE = 0.6


def words_of(text: str | bytes) -> list[bytes]:
    return WORD.findall((text.encode() if isinstance(text, str) else text).lower())


@dataclass(frozen=True)
class Template:
    """``notice``: the text must stand as it is; else ``phrases`` must and COVERAGE of its words."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()
    notice: bool = False

    @cached_property
    def words(self) -> list[bytes]:
        return words_of(self.text)

    @cached_property
    def keys(self) -> list[tuple[int, list[bytes]]]:
        """(position in the text, words) of each key phrase."""
        out = []
        for p in map(words_of, self.phrases):
            at = [i for i in range(len(self.words)) if self.words[i:i + len(p)] == p]
            if not p or not at:
                raise ValueError(f"{self.label}: a key phrase must be part of the text")
            out.append((at[0], p))
        return out

    @cached_property
    def needed(self) -> frozenset[bytes]:
        return frozenset(self.words if self.notice else (w for _, p in self.keys for w in p))

    @cached_property
    def places(self) -> dict[bytes, list[int]]:
        out = defaultdict(list)
        for i, w in enumerate(self.words):
            out[w].append(i)
        return dict(out)


#: The notices of the base scan.
NOTICES = (Template("mit", "mit license", notice=True), Template("apache", "apache license", notice=True), Template("gpl", "general public license", notice=True))

#: Opening or characteristic passages of public licence texts and the usual short notices.
TEXTS = (
    Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so""",
             ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies.""",
             ("for any purpose with or without fee is hereby granted",)),
    Template("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.""",
             ("redistribution and use in source and binary forms", "are permitted provided that the following conditions are met")),
    Template("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at""", ("you may not use this file except in compliance with the license",)),
    Template("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
             ("you can redistribute it and or modify it under the terms of the gnu general public license",)),
    Template("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
             ("under the terms of the gnu lesser general public license",)),
    Template("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at""", ("subject to the terms of the mozilla public license",)),
    Template("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
        or distribute this software""", ("this is free and unencumbered software released into the public domain",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0 international license",)),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
             ("creative commons attribution sharealike 4 0 international license",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("licensed under cc by nc",)),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
             ("creative commons attribution noncommercial 4 0 international license",)),
)


class Index:
    """Positional index of the templates, with the IDF of their words."""

    def __init__(self, templates: Sequence[Template], idf: dict[bytes, float]):
        self.templates, self.idf = list(templates), idf
        self.vocabulary = frozenset(w for t in templates for w in t.words)

    def rare(self, words) -> list[bytes]:
        return sorted(words, key=lambda w: (-self.idf.get(w, math.inf), w))

    def notice(self, t: Template, at: dict[bytes, list[int]], n: int) -> list[tuple[int, float]]:
        """All places of a notice: the postings of its rarest word, intersected with the others' at their distances."""
        order = self.rare(t.places)
        starts = {i - t.places[order[0]][0] for i in at[order[0]]}
        for w in order:
            seen = set(at[w])
            for p in t.places[w]:
                starts = {s for s in starts if s + p in seen}
        return [(s, 1.0) for s in sorted(starts) if s >= 0 and s + len(t.words) <= n]

    def licence(self, t: Template, at: dict[bytes, list[int]], words: list[bytes]) -> list[tuple[int, float, bool]]:
        """(start, coverage, accepted) of every place that enough rare words agree on."""
        votes = defaultdict(set)
        for w in self.rare([w for w in t.places if at.get(w)])[:LOOK]:
            for p in t.places[w]:
                for i in at[w]:
                    votes[i - p].add(w)
        out, starts = [], sorted(votes)
        a = 0
        while a < len(starts):
            b = a + 1
            while b < len(starts) and starts[b] - starts[b - 1] <= SLACK:
                b += 1
            shifts = starts[a:b]                                            # one text whose parts are shifted a little
            a = b
            if len(set().union(*(votes[s] for s in shifts))) < min(AGREE, len(t.places)):
                continue
            n = len(words)
            found = [any(0 <= s + p < n and words[s + p] == w for s in shifts) for p, w in enumerate(t.words)]
            coverage = sum(found) / len(found)
            whole = all(any(s + p >= 0 and words[s + p:s + p + len(k)] == k for s in shifts) for p, k in t.keys)
            best = max(shifts, key=lambda s: (len(votes[s]), -s))
            out.append((max(0, best), coverage, whole and coverage >= COVERAGE))
        return out

    def scan(self, text: bytes) -> tuple[int, list[dict]]:
        """(number of words, places) of a text in UTF-8."""
        words = words_of(text)
        present = self.vocabulary.intersection(words)
        wanted = [t for t in self.templates if t.needed <= present]
        if not wanted:
            return len(words), []
        used = frozenset(w for t in wanted for w in t.places)
        at = defaultdict(list)
        for i, w in enumerate(words):
            if w in used:
                at[w].append(i)
        places = []
        for t in wanted:
            got = [(s, c, True) for s, c in self.notice(t, at, len(words))] if t.notice else self.licence(t, at, words)
            places += [{"label": t.label, "notice": t.notice, "start": s, "stop": min(len(words), s + len(t.words)), "coverage": c, "accepted": ok} for s, c, ok in got]
        return len(words), places


def word_idf(docs: DataFrame, templates: Sequence[Template]) -> dict[bytes, float]:
    """IDF over all documents of the templates' words; what reaches the driver is a row a licence word."""
    vocabulary = frozenset(w for t in templates for w in t.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0
        for b in batches:
            n += len(b)
            for text in b.column(0):
                seen.update(vocabulary.intersection(words_of(text.as_buffer().to_pybytes())))
        yield pa.RecordBatch.from_pydict({"word": pa.array([b"", *seen], pa.binary()), "files": pa.array([n, *seen.values()], pa.int64())})
    rows = docs.select(F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(released(count), "word binary, files long")
    files = {bytes(r.word): r.files for r in rows.groupBy("word").agg(F.sum("files").alias("files")).collect()}
    total = files.pop(b"", 0)
    return {w: math.log((1 + total) / (1 + files.get(w, 0))) for w in vocabulary}


_PLACE = pa.struct([("label", pa.string()), ("notice", pa.bool_()), ("start", pa.int64()), ("stop", pa.int64()), ("coverage", pa.float64()), ("accepted", pa.bool_())])


def scan(docs: DataFrame, templates: Sequence[Template] = NOTICES + TEXTS) -> DataFrame:
    """doc_id, n_words, places: array of (label, notice, start, stop, coverage, accepted), words counted from 0."""
    idf = word_idf(docs, templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates, idf)
        for b in batches:
            got = [index.scan(x.as_buffer().to_pybytes()) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([p for _, p in got], pa.list_(_PLACE))], names=["doc_id", "n_words", "places"])
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(released(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, "
                           "places array<struct<label:string,notice:boolean,start:long,stop:long,coverage:double,accepted:boolean>>")


def summary(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of ``scan``'s rows. The score is the best coverage, accepted or not;
    a notice covers itself."""
    base = F.filter("places", lambda p: p["notice"])
    starts = F.transform(base, lambda p: p["start"])
    joined = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                        joined(base).alias("base_labels"), joined(F.filter("places", lambda p: p["accepted"])).alias("labels"),
                        F.coalesce(F.array_max(F.transform("places", lambda p: p["coverage"])), F.lit(0.0)).alias("score"))
