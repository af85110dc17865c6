"""License scans with a positional index of rare words.

The notices' words are an index: word to (notice, position). A file looks up its own licence words, those with the
highest inverse document frequency over the whole corpus first. A notice of which too few words occur in the file is
out; of any other, the file's rarest words vote, more of them than may be missing, so that two at least stand where the
notice does. Two votes whose places agree with their positions in the notice start a chain, which goes on to both sides
word by word; up to SLACK strange words may stand between two words of a notice, as comment signs and names do. A chain is
taken when it covers enough of the notice and a mandatory phrase stands in it unbroken. Three short phrases are labels by themselves.

Edge cases: null and empty texts have no words, no labels and score 0; words are counted from 0; repeated rows are
each returned with equal results; words of equal frequency are taken by their letters; an empty table gives an empty
result; texts are read whole; columns other than the id and the text are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

#: A-Z lower-cased; whatever is no digit, letter or character beyond ASCII parts words.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: The phrases of the base labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Notices as (label, words, phrases of them one of which must stand there).
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("general public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("permission is hereby granted free of charge", "this permission notice shall be included")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistribution and use in source and binary forms",)),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("apache license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose", ("gnu general public license",)),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software", ("permission is granted to anyone to use this software",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("permission to use copy modify",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("cc0", "this work is dedicated to the public domain under cc0 1 0 universal", ("cc0 1 0",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
)

#: Strange words that may stand between two of a notice; share of a notice that must stand there.
SLACK, COVER = 3, 0.7
#: Words that begin a line of comment.
COMMENTS = frozenset((b"rem", b"dnl"))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def _split(phrase: str) -> list[bytes]:
    return phrase.encode().split()


def _runs(words: list[bytes], phrase: list[bytes], at: list[int]) -> list[int]:
    """Starts of a phrase, from the places of its last word."""
    n = len(phrase) - 1
    return [i - n for i in at if i >= n and words[i - n : i + 1] == phrase]


class Scanner:
    def __init__(self, idf: dict[bytes, float], notices=NOTICES, phrases=PHRASES):
        self.phrases = [(p.encode().split(), label) for p, label in phrases]
        self.notices = [(label, words.encode().split()) for label, words, _ in notices]
        #: of each notice the stretches of positions where its mandatory phrases stand
        self.must = [[range(i, i + len(m)) for m in map(_split, must) for i in range(len(words)) if words[i : i + len(m)] == m] for (_, words), (_, _, must) in zip(self.notices, notices, strict=True)]
        self.postings: dict[bytes, list[tuple[int, list[int]]]] = defaultdict(list)
        #: of each notice the words that may be missing, and the distinct words that must be somewhere in the file
        self.spare, self.least = [], []
        for k, (_, words) in enumerate(self.notices):
            for word in set(words):
                self.postings[word].append((k, [i for i, w in enumerate(words) if w == word]))
            self.spare.append(len(words) - math.ceil(COVER * len(words)))
            self.least.append(len(set(words)) - self.spare[-1])
        self.rank = {w: (-idf.get(w, 0.0), w) for w in self.postings}
        self.wanted = frozenset((*self.postings, *(p[-1] for p, _ in self.phrases)))

    def __call__(self, text: str | None) -> tuple[int, list[int], set[str], set[str], float]:
        """Number of words, starts of base phrases, base labels, the notices' labels, score."""
        words = words_of(text)
        present = self.wanted.intersection(words)
        if not present:
            return len(words), [], set(), set(), 0.0
        votes: dict[int, list[tuple[bytes, list[int]]]] = defaultdict(list)
        for w in sorted(present.intersection(self.postings), key=self.rank.__getitem__):
            for k, at in self.postings[w]:
                votes[k].append((w, at))
        votes = {k: v for k, v in votes.items() if len(v) >= self.least[k]}
        ends = present.intersection(p[-1] for p, _ in self.phrases)
        if not votes and not ends:
            return len(words), [], set(), set(), 0.0
        places: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in present:
                places[w].append(i)
        starts, base = [], set()
        for phrase, label in self.phrases:
            if found := _runs(words, phrase, places.get(phrase[-1], [])):
                starts += found
                base.add(label)
        best, labels = 0.0, set()
        for k, held in votes.items():
            if (here := self._stands(k, held[: self.spare[k] + 2], words, places)) > 0:
                labels.add(self.notices[k][0])
                best = max(best, here)
        return len(words), starts, base, labels, max(best, 0.5 * bool(base))

    def _stands(self, k: int, votes: list[tuple[bytes, list[int]]], words: list[bytes], places: dict[bytes, list[int]]) -> float:
        """The greatest cover of notice k by a chain with a mandatory phrase, 0 where none covers enough."""
        notice = self.notices[k][1]
        anchors = sorted((p, i) for w, at in votes for p in places[w] for i in at)
        best, tried = 0.0, set()
        for x, (p, i) in enumerate(anchors):
            if (p, i) in tried:
                continue
            for q, j in anchors[x + 1 :]:  # the nearest agreeing anchor after this one
                if q - p > len(notice) * (SLACK + 1):
                    break
                if j > i and j - i - self.spare[k] <= q - p <= (j - i) * (SLACK + 1):
                    chain = self._chain(notice, p, i, places)
                    tried.update(chain)
                    cover = len(chain) / len(notice)
                    if cover >= COVER and cover > best:
                        at = {j: p for p, j in chain}
                        if any(_unbroken([at.get(j, -1) for j in m], words) for m in self.must[k]):
                            best = cover
                    break
        return best

    def _chain(self, notice: list[bytes], p: int, i: int, places: dict[bytes, list[int]]) -> list[tuple[int, int]]:
        """(place, position) of the notice's words that stand around an anchor, each the nearest to the one before it."""
        after, before = [(p, i)], []
        for j in range(i + 1, len(notice)):
            q, last = after[-1]
            at = places.get(notice[j], ())
            x = bisect_right(at, q)
            if x < len(at) and at[x] <= q + (j - last) + SLACK:
                after.append((at[x], j))
        for j in range(i - 1, -1, -1):
            q, last = before[-1] if before else (p, i)
            at = places.get(notice[j], ())
            x = bisect_left(at, q) - 1
            if x >= 0 and at[x] >= q - (last - j) - SLACK:
                before.append((at[x], j))
        return before[::-1] + after


def _unbroken(at: list[int], words: list[bytes]) -> bool:
    """Whether a phrase's words, at these places (-1: missing), follow one another with no more than comment words between."""
    return min(at) >= 0 and all(COMMENTS.issuperset(words[a + 1 : b]) for a, b in zip(at, at[1:]))


def document_frequencies(texts: DataFrame) -> dict[bytes, float]:
    """Inverse document frequency of every word of the notices over all texts (column `text`)."""
    vocabulary = frozenset(w for _, words, _ in NOTICES for w in words.encode().split())

    def count(batches):
        tally: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                tally.update(vocabulary.intersection(words_of(text)))
                tally[b""] += 1
        yield pa.record_batch([pa.array([w.decode() for w in tally], pa.string()), pa.array(list(tally.values()), pa.int64())], ["word", "n"])

    rows = texts.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    seen = {r.word.encode(): r.n for r in rows}
    return {w: math.log((1 + seen.get(b"", 0)) / (1 + seen.get(w, 0))) for w in vocabulary}


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    idf = document_frequencies(texts)

    def run(batches):
        scanner = Scanner(idf)
        for batch in batches:
            got = [scanner(t) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([
                batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([len(g[1]) for g in got], pa.int64()),
                pa.array([min(g[1], default=None) for g in got], pa.int64()), pa.array([max(g[1], default=None) for g in got], pa.int64()),
                pa.array([",".join(sorted(g[2])) for g in got], pa.string()), pa.array([",".join(sorted(g[2] | g[3])) for g in got], pa.string()),
                pa.array([g[4] for g in got], pa.float64()),
            ], ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.mapInArrow(run, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
