"""License scans by a positional index of rare words."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm.common import narrowed, short_batches, slices, table, text_bytes
from stemma.llm.words import DELIMITERS

#: Rare words under which a template stands in the index, and the least share of its words that a match has.
RARE, COVER = 3, 0.6
_TABLE = bytes(ord(" ") if c in DELIMITERS else c for c in bytes(range(256)).lower())

#: The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Wording of well-known licenses (public notices): label, text, key phrases that a match must have.
NOTICES = (
    ("apache-2.0", "apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", ("apache license version 2 0", "may not use this file except in compliance")),
    ("gpl-2.0", "gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license as published by the free software foundation",)),
    ("lgpl", "gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "gnu affero general public license", ("gnu affero general public license",)),
    ("cc-by-4.0", "cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc", "cc by nc", ("cc by nc",)),
    ("cc-by-nc-4.0", "cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa", "cc by sa", ("cc by sa",)),
    ("cc-by-nd", "cc by nd", ("cc by nd",)),
    ("cc-by", "creative commons attribution", ("creative commons attribution",)),
    ("cc0", "creative commons zero", ("creative commons zero",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee is hereby granted",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("mpl", "mozilla public license", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement", ("permission is hereby granted free of charge", "the above copyright notice and this permission notice shall be included")),
    ("bsd-3-clause", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution 3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("redistribution and use in source and binary forms", "neither the name of the copyright holder nor the names of its contributors")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness", ("for any purpose with or without fee is hereby granted", "the author disclaims all warranties with regard to this software")),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ("distributed on an as is basis without warranties or conditions of any kind", "language governing permissions and limitations under the license")),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program", ("in the hope that it will be useful but without any warranty", "you should have received a copy of the gnu general public license")),
)


class Template(NamedTuple):
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[int, tuple[bytes, ...]], ...]  # key phrases and where they stand in it
    base: bool


def _words(text: str) -> tuple[bytes, ...]:
    return tuple(text.encode().translate(_TABLE).split())


def templates(phrases: dict[str, str] = PHRASES, notices: tuple = NOTICES) -> list[Template]:
    """A base phrase is its own key; other key phrases must stand where the template has them."""
    out = [Template(label, _words(p), ((0, _words(p)),), True) for p, label in phrases.items()]
    for label, text, keys in notices:
        ws = _words(text)
        at = [(next(i for i in range(len(ws)) if ws[i : i + len(k)] == k), k) for k in map(_words, keys)]
        out.append(Template(label, ws, tuple(at), False))
    return out


def split(text: bytes) -> list[bytes]:
    """Words: A-Z lower-cased, cut at ASCII characters that are neither letters nor digits."""
    return text.translate(_TABLE).split()


class Index:
    """Rare word -> (template, place in it). A template stands under the rarest words of its key phrases."""

    def __init__(self, made: list[Template], idf: dict[bytes, float], rare: int = RARE) -> None:
        self.templates, self.idf = made, idf
        self.posts: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed = []
        for t, x in enumerate(made):
            place = {x.words[at + i]: at + i for at, key in reversed(x.keys) for i in reversed(range(len(key)))}
            chosen = sorted(place, key=lambda w: (-idf.get(w, 0.0), w))[:rare]
            self.needed.append(len(chosen))
            for w in chosen:
                self.posts[w].append((t, place[w]))
        self.rare = frozenset(self.posts)

    def scan(self, ws: list[bytes]) -> list[tuple[int, int, float]]:
        """Matches (template, first word, share of its words that agree), sorted.

        The file's rare words are looked up from the highest IDF down. Each of a template's words gives the
        places where it would have to begin; key phrases are mandatory, so only places that all its words
        give are left, and a template that lacks a word falls at once. There its key phrases must stand word
        for word.
        """
        if self.rare.isdisjoint(ws):
            return []
        places = defaultdict(list)
        for i, w in enumerate(ws):
            if w in self.rare:
                places[w].append(i)
        starts: dict[int, set[int]] = {}
        met = Counter()
        for w in sorted(places, key=lambda w: (-self.idf.get(w, 0.0), w)):
            for t, place in self.posts[w]:
                own = starts.get(t)
                starts[t] = {i - place for i in places[w] if own is None or i - place in own}
                met[t] += 1
        found = []
        for t in sorted(t for t, n in met.items() if n == self.needed[t]):
            x = self.templates[t]
            for start in sorted(starts[t]):
                if all(start + at >= 0 and tuple(ws[start + at : start + at + len(key)]) == key for at, key in x.keys):
                    agree = sum(0 <= start + i < len(ws) and ws[start + i] == w for i, w in enumerate(x.words))
                    if agree >= COVER * len(x.words):
                        found.append((t, start, agree / len(x.words)))
        return found


def inverse_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, float]:
    """IDF of the given words over all documents. Each batch adds up; what comes back has a row a word."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = Counter(), 0
        for b in batches:
            for text in text_bytes(b):
                total.update(vocabulary.intersection(split(text)))
                n += 1
        total[b""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {bytes(r.word): r.n for r in rows}
    return {w: math.log((1 + n.get(b"", 0)) / (1 + n.get(w, 0))) for w in vocabulary}


SCHEMA = "doc_id long, n_words long, matches array<struct<label:string,base:boolean,first:long,words:long,share:double>>"


def scan(docs: DataFrame, made: list[Template] | None = None) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_words, and all matches of license templates, by template and place.

    Two passes over the texts, which are never moved: the document frequencies of the templates' words, then
    the look-up. A template stands only under words that it must have, so each place of a base phrase is found.

    Null and empty texts have no words. Repeated rows are scanned each; a null doc_id stays null. No rows: no
    rows.
    """
    short_batches(docs.sparkSession)
    made = made or templates()
    source = narrowed(docs, "doc_id", "text")
    source = source.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    idf = inverse_frequencies(source, frozenset(w for t in made for w in t.words))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(made, idf)
        kind = pa.list_(pa.struct([("label", pa.string()), ("base", pa.bool_()), ("first", pa.int64()), ("words", pa.int64()), ("share", pa.float64())]))
        for b in slices(batches):
            counts, matches = [], []
            for text in text_bytes(b):
                ws = split(text)
                counts.append(len(ws))
                matches.append([{"label": made[t].label, "base": made[t].base, "first": start, "words": len(made[t].words), "share": share} for t, start, share in index.scan(ws)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(matches, kind)], ["doc_id", "n_words", "matches"])

    return source.mapInArrow(scanned, SCHEMA)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("matches", lambda m: m.base)
    labels = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m.label))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["first"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["first"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m.share)), F.lit(0.0)).alias("score"),
    )
