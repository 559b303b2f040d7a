"""Licence scans: sparse TF-IDF cosine to templates, then inheritance along paths.

A file's units (its lines, its paragraphs, every window of a template's length and the
whole text) become
sparse TF-IDF vectors over their words. Document frequencies of all words are
counted over all files: those of the templates' words go to the driver, those of
other words are joined to the units that hold them. As a word weighs 1 at least, a
unit that cannot reach ``LEAST`` whatever its other words weigh is known before the
join and skipped; a file of such units only has score 0. Whole texts of any length are
compared with full licence texts too (``licence_texts``). The best unit's template is
the file's own licence if its cosine reaches ``LEAST``. A licence file (by name or, on request, a text that
is one as a whole) licenses its directory; files without a licence of their own inherit from the
nearest ancestor directory that has one, found by joining on every ancestor path.

Defined cases: null or empty texts have no licence of their own and may inherit; a
null path has no directory; ties go to the first template by name; an SPDX tag names its
licences by itself, with score 1; of several
licence files in a directory to the highest cosine, then the first path; repeated
rows count each; very long texts are read whole; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.licence_texts import FULL
from maskwright.llm._store import prepare, stage

LEAST = 0.75
SALTS = 16
#: A task's counts of words go out in parts of about so many words.
COUNTED = 500_000
NAMES = r"(?i)^(licen[cs]e|copying|unlicense|notice)([._-].*)?$"
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    "GPL-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License, version 2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", "This work is licensed under the GNU General Public License, version 2."),
    "LGPL-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    "LGPL-3.0": ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"),
    "MIT": ("Released under the MIT License.", "Permission is hereby granted, free of charge, to any person" " obtaining a copy of this software", "This project is licensed under the MIT license.", "Licensed under the MIT License."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
}
#: An SPDX tag and the names that it may hold, with or without -only, -or-later and +.
_SPDX = re.compile(r"(?i)SPDX-License-Identifier:[ \t]*([^\r\n]*)")
_SPDX_NAME = re.compile(r"[a-z0-9][a-z0-9.-]*")
_TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


#: The words of all templates and full texts.
VOCABULARY = sorted({t for ts in [*TEMPLATES.values(), FULL.values()] for x in ts for t in terms(x)})


#: Dot product with a template, its name, squared norm of the words of templates, whether it is the whole text, other words and their counts.
Unit = tuple[float, str, float, bool, tuple[tuple[str, int], ...]]
_NAMES = ("dot", "name", "norm", "whole", "words")
_WORDS = pa.list_(pa.struct([("term", pa.string()), ("c", pa.int64())]))
_UNITS = pa.list_(pa.struct([("dot", pa.float64()), ("name", pa.string()), ("norm", pa.float64()), ("whole", pa.bool_()), ("words", _WORDS)]))


#: Every name that a file may get, by its name in lower case.
NAMED = {name.lower(): name for name in [*TEMPLATES, *FULL]}


def tagged(text: str) -> str | None:
    """The first by name of the known licences in the text's SPDX tags."""
    found = set()
    for tag in _SPDX.findall(text):
        # Of an expression, words that join names are no names themselves; after the expression other text may follow.
        rest = iter(tag.lower().replace("(", " ").replace(")", " ").split())
        for word in rest:
            m = _SPDX_NAME.match(word)
            if m:
                found.add(NAMED.get(re.sub(r"-(only|or-later)$", "", m[0].rstrip(".-"))))
            joined = next(rest, None)
            while joined == "with":  # an exception, which is no licence
                next(rest, None)
                joined = next(rest, None)
            if joined not in ("and", "or"):
                break
    return min(found - {None}, default=None)


class Index:
    """Postings of the words of some templates."""

    def __init__(self, templates: list[tuple[str, str]], idf: dict[str, float]) -> None:
        self.names = [name for name, _ in templates]
        self.lengths: list[int] = []
        self.weights: list[dict[str, float]] = []
        self.strong: list[set[str]] = []
        self.postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for i, (_, text) in enumerate(templates):
            weights = {t: c * idf[t] for t, c in Counter(terms(text)).items()}
            norm = math.sqrt(sum(w * w for w in weights.values()))
            self.lengths.append(len(terms(text)))
            self.weights.append({t: w / norm for t, w in weights.items()})
            # A unit without a strong term of the template can't reach LEAST with it: the weights of the others stay below.
            left, strong = 0.0, set()
            for t, w in sorted(weights.items(), key=lambda x: x[1]):
                left += (w / norm) ** 2
                if left >= LEAST * LEAST - 1e-9:
                    strong.add(t)
            self.strong.append(strong)
            for t, w in weights.items():
                self.postings[t].append((i, w / norm))

    def reached(self, words: set[str]) -> list[int]:
        """Templates that a unit of these words may reach LEAST with: no cosine exceeds the norm of the shared part of the template."""
        share = [0.0] * len(self.names)
        for t in self.postings.keys() & words:
            for i, x in self.postings[t]:
                share[i] += x * x
        return [i for i, s in enumerate(share) if s >= LEAST * LEAST - 1e-9]


class Matcher:
    """Scores units against the templates."""

    def __init__(self, df: dict[str, int], files: int) -> None:
        self.idf = {t: math.log((1 + files) / (1 + df.get(t, 0))) + 1 for t in VOCABULARY}
        self.rest = math.log(1 + files) + 1
        self.heads = Index([(name, text) for name in sorted(TEMPLATES) for text in TEMPLATES[name]], self.idf)
        self.full = Index(sorted(FULL.items()), self.idf)

    def measure(self, words: list[str], index: Index) -> tuple[float, str | None, float, dict[str, int]]:
        """Dot product with the nearest template, its name, the squared norm of the words of templates, and the other words."""
        if not index.reached(set(words)):
            return 0.0, None, 0.0, {}
        scores: dict[int, float] = defaultdict(float)
        norm, others = 0.0, {}
        for t, c in Counter(words).items():
            if t not in self.idf:
                others[t] = c
                continue
            w = c * self.idf[t]
            norm += w * w
            for i, x in index.postings.get(t, ()):
                scores[i] += w * x
        i = min(scores, key=lambda k: (-scores[k], index.names[k]))
        return scores[i], index.names[i], norm, others

    def best(self, words: list[str]) -> tuple[float, str | None]:
        """Cosine and template, if all words outside the templates are seen nowhere: no less is possible."""
        dot, name, norm, others = self.measure(words, self.heads)
        return _cosine(dot, norm, others, self.rest), name

    def units(self, text: str | None) -> list[Unit]:
        """The units that may reach LEAST and be the text's best, and the whole text if it may reach LEAST."""
        if not text:
            return []
        found: list[tuple[float, Unit]] = []
        floor = 0.0
        tag = tagged(text)
        if tag:
            floor = 1.0
            found.append((1.0, (1.0, tag, 1.0, False, ())))
        everything = terms(text)
        have = set(everything)
        pieces = [(True, everything, self.full)] if self.full.reached(have) else []
        near = self.heads.reached(have)
        if near:
            pieces += [(whole, words, self.heads) for whole, words in _pieces(text)]
            pieces += [(False, words, self.heads) for i in near for words in self.windows(everything, i)]
        for whole, words, index in pieces:
            dot, name, norm, others = self.measure(words, index)
            most = _cosine(dot, norm, others, 1.0)  # a word of all files weighs 1
            if name is not None and most >= LEAST - 1e-9:
                floor = max(floor, _cosine(dot, norm, others, self.rest))
                found.append((most, (dot, name, norm, whole, tuple(others.items()))))
        return list(dict.fromkeys(u for most, u in found if u[3] or most >= floor - 1e-9))


    def windows(self, words: list[str], i: int) -> Iterator[list[str]]:
        """The windows of a template's length that may reach LEAST with it, kept up word by word."""
        size, mine, strong = self.heads.lengths[i], self.heads.weights[i], self.heads.strong[i]
        last = -1  # the first starts up to here are done
        for p in (p for p, t in enumerate(words) if t in strong):
            low, high = max(last + 1, p - size + 1, 0), min(p, len(words) - size)
            if low > high:
                continue
            last = high
            count: Counter[str] = Counter(words[low: low + size])
            dot = sum(c * self.idf[t] * mine[t] for t, c in count.items() if t in mine)
            norm = sum((c * self.idf.get(t, 1.0)) ** 2 for t, c in count.items())
            for start in range(low, high + 1):
                if dot > 0 and dot * dot >= (LEAST * LEAST - 1e-6) * norm:
                    yield words[start: start + size]
                if start < high:
                    for t, step in ((words[start], -1), (words[start + size], 1)):
                        w = self.idf.get(t, 1.0)
                        norm += w * w * (2 * step * count[t] + 1)
                        count[t] += step
                        dot += step * w * mine.get(t, 0.0)


def _cosine(dot: float, norm: float, others: dict[str, int], weight: float) -> float:
    total = norm + weight * weight * sum(c * c for c in others.values())
    return dot / math.sqrt(total) if total else 0.0


def _pieces(text: str) -> Iterator[tuple[bool, list[str]]]:
    """The words of each line, of each paragraph and of the whole text, which comes with True."""
    words: list[str] = []
    para: list[str] = []
    for line in [*text.split("\n"), ""]:
        if line.strip():
            unit = terms(line)
            if unit:
                yield False, unit
                para += unit
        elif para:
            yield False, para
            words += para
            para = []
    if words:
        yield True, words


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, files that hold it) in parts; the empty term counts the files."""
    count: Counter[str] = Counter()

    def part() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["term", "n"])

    for batch in batches:
        for t in batch.column(0):
            count[""] += 1
            text = t.as_py()
            if text:
                count.update(set(terms(text)))
            if len(count) > COUNTED:
                yield part()
                count.clear()
    yield part()


def _scan(df: dict[str, int], files: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Matcher(df, files)
        for batch in batches:
            units = [[dict(zip(_NAMES, (*u[:4], [{"term": t, "c": c} for t, c in u[4]]))) for u in tool.units(t.as_py())] for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(units, _UNITS)], names=["row", "id", "path", "units"])

    return run


def _scored(files: DataFrame) -> DataFrame:
    """(id, path, own, score, whole) of every file: the best of its units, weighed by the frequencies of all words."""
    parts = files.select("text").mapInArrow(_frequencies, "term string, n long")
    counts = stage(parts.groupBy("term").agg(F.sum("n").alias("n")), "frequencies")
    found = {r["term"]: r["n"] for r in counts.filter(F.col("term").isin(["", *VOCABULARY])).collect()}  # a row for each word of the templates
    total = found.pop("", 0)
    keyed = files.select(F.monotonically_increasing_id().alias("row"), F.col("id").cast("long").alias("id"), "path", "text")
    kind = "array<struct<dot: double, name: string, norm: double, whole: boolean, words: array<struct<term: string, c: long>>>>"
    scanned = stage(keyed.mapInArrow(_scan(found, total), f"row long, id long, path string, units {kind}"), "units")
    units = scanned.select("row", F.posexplode("units").alias("u", "unit")).select("row", "u", "unit.*")
    weight = F.log(F.lit(1.0 + total) / (1 + F.coalesce("n", F.lit(0)))) + 1
    words = units.select("row", "u", F.explode("words").alias("word")).select("row", "u", "word.*")
    others = words.join(counts, "term", "left").groupBy("row", "u").agg(F.sum(F.pow(F.col("c") * weight, F.lit(2.0))).alias("others"))
    cosine = F.round(F.col("dot") / F.sqrt(F.col("norm") + F.coalesce("others", F.lit(0.0))), 9)
    best = units.join(others, ["row", "u"], "left").withColumn("score", F.least(F.lit(1.0), cosine)).groupBy("row").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "name")).alias("best"), F.max(F.col("whole") & (F.col("score") >= LEAST)).alias("whole"))
    score = F.coalesce(-F.col("best.s"), F.lit(0.0))
    return scanned.select("row", "id", "path").join(best, "row", "left").select("id", "path", F.when(score >= LEAST, F.col("best.name")).alias("own"), score.alias("score"), F.coalesce("whole", F.lit(False)).alias("whole"))


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def scan_licences(files: DataFrame, by_text: bool = False) -> DataFrame:
    """(id, path, own_licence, score, licence, licence_dir) of every row of files (id, path, text).

    by_text: a file whose whole text is a licence is a licence file, whatever its name.
    """
    prepare(files.sparkSession)
    scanned = stage(_scored(files), "licences")
    base = F.regexp_extract(F.col("path"), r"(?s)([^/]*)$", 1)
    holders = scanned.filter(F.col("own").isNotNull() & F.col("path").isNotNull() & ((F.col("whole") & F.lit(by_text)) | base.rlike(NAMES)))
    dirs = holders.groupBy(parent(F.col("path")).alias("dir")).agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "own")).alias("best"))
    dirs = dirs.select("dir", F.col("best.own").alias("dir_licence"))
    # Directories of all files, each once, meet the licensed ones on every ancestor.
    folders = scanned.filter("path IS NOT NULL").select(parent(F.col("path")).alias("folder")).distinct()
    pieces = F.split("folder", "/", -1)
    folders = folders.withColumn("up", F.explode(F.transform(F.sequence(F.lit(0), F.size(pieces)), lambda k: F.when(k == 0, F.lit("")).otherwise(F.array_join(F.slice(pieces, F.lit(1), k), "/")))))
    near = folders.join(dirs, F.col("up") == F.col("dir")).groupBy("folder").agg(F.max(F.struct(F.length("up").alias("n"), "up", "dir_licence")).alias("near"))
    near = near.select("folder", F.col("near.up").alias("licence_dir"), F.col("near.dir_licence").alias("dir_licence")).withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = scanned.withColumn("salt", F.pmod(F.xxhash64("id", "path"), F.lit(SALTS)).cast("int"))
    met = rows.join(near, (parent(F.col("path")) == F.col("folder")) & (F.col("salt") == F.col("t")), "left")
    inherited = F.col("own").isNull()
    return met.select("id", "path", F.col("own").alias("own_licence"), F.round("score", 6).alias("score"), F.coalesce("own", "dir_licence").alias("licence"), F.when(inherited, F.col("licence_dir")).alias("licence_dir"))


def query_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = docs.select(F.col("doc_id").cast("long").alias("id"), path.alias("path"), "text")
    return scan_licences(files, by_text=True).withColumnRenamed("id", "doc_id")
