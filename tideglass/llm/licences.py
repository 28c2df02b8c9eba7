"""Licences of documents: TF-IDF cosine of their lines and texts to templates, and inheritance along directories."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from importlib import resources

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import tables as t

# Notices by which public licences are applied (SPDX id, text), and the names, versions and elements of those that come in variants.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("ISC", "Released under the ISC License."),
    ("ISC", "This project is licensed under the terms of the ISC License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)
GNU = (
    ("GPL", "General Public License", ("1.0", "2.0", "3.0")),
    ("LGPL", "Library General Public License", ("2.0",)),
    ("LGPL", "Lesser General Public License", ("2.1", "3.0")),
    ("AGPL", "Affero General Public License", ("3.0",)),
)
GNU_FORMS = (
    "This work is licensed under the GNU {name}, version {version}.",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
    "Licensed under the {short}v{version}.",
)
CC = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")
CC_FORMS = (
    "Licensed under CC {short} {version}.",
    "This work is licensed under a Creative Commons {name} {version} License.",
    "This work is licensed under a Creative Commons {name} {version} International License.",
)
# Pieces of words that name a licence or tell its variants apart.
NAMES = {
    "apache": "apache", "bsd": "bsd", "cc": "cc", "creative": "cc", "gnu": "gnu", "gpl": "gnu", "lgpl": "gnu", "agpl": "gnu", "isc": "isc", "mit": "mit", "mozilla": "mozilla",
    "mpl": "mozilla", "unlicense": "unlicense", "cc0": "cc0",
}
VARIANTS = {
    "lgpl": "lesser", "lesser": "lesser", "agpl": "affero", "affero": "affero", "documentation": "documentation", "fdl": "documentation", "nc": "nc", "noncommercial": "nc", "commercial": "nc",
    "nd": "nd", "noderivatives": "nd", "noderivs": "nd", "derivatives": "nd", "derivs": "nd", "sa": "sa", "sharealike": "sa", "alike": "sa",
}
KINDS, CALLED = frozenset(VARIANTS.values()), frozenset(NAMES.values())


def _templates() -> tuple[tuple[str, str], ...]:
    """All notices: those above, each variant and version in each form, and SPDX tags of all ids."""
    brief = lambda v: v.removesuffix(".0")
    out = [*NOTICES]
    out += [(f"{short}-{v}", form.format(short=short, name=name, version=brief(v))) for short, name, versions in GNU for v in versions for form in GNU_FORMS]
    out += [(f"CC-{short}-{v}", form.format(short=short, name=name, version=v)) for short, name in CC for v in CC_VERSIONS for form in CC_FORMS]
    for i in sorted({i for i, _ in out}):
        out += [(i, f"SPDX-License-Identifier: {i}{end}") for end in (("", "-only", "-or-later") if "GPL" in i else ("",))]
    return tuple(out)


TEMPLATES = _templates()
ONE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"  # scripts without blanks between words: each letter counts
WORD = re.compile(rf"[{ONE}]|[^\W_{ONE}]+(?:[.-][^\W_{ONE}]+)*")
RARE, MOST_WORDS = 1e-3, 300_000
HEADER, NAMED, FILE = 0.8, 0.6, 0.6  # least cosine of a line, of one that has the licence's name and version, and of a whole text that is a licence file


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


VERSION = re.compile(r"v?(\d{1,2}(?:\.\d{1,2})*)")
GNU_VERSION = re.compile(r"([al]?gpl)v?(\d(?:\.\d)?)")  # GPLv2, LGPL2.1


@lru_cache(1 << 16)
def marks_of(word: str) -> frozenset[str]:
    """Names, variants and versions in a word; versions without their last zeros."""
    found = set()
    for piece in word.split("-"):
        if joined := GNU_VERSION.fullmatch(piece):
            piece = joined[1]
            found.add(joined[2].removesuffix(".0"))
        elif number := VERSION.fullmatch(piece):
            found.add(re.sub(r"(\.0)+$", "", number[1]))
        found |= {kind[piece] for kind in (NAMES, VARIANTS) if piece in kind}
    return frozenset(found)


def marks(words: list[str]) -> frozenset[str]:
    """Those of all words. The Library GPL is what the Lesser GPL was called before."""
    old = {"lesser" for a, b in zip(words, words[1:]) if a == "gnu" and b == "library"}
    return frozenset(old.union(*map(marks_of, words)))


def fits(found: frozenset[str], wanted: frozenset[str]) -> bool:
    """Whether words with these marks may be a notice with those: none of its own is missing, and no variant is there that it isn't of."""
    return wanted <= found and found & KINDS == wanted & KINDS


def _texts() -> tuple[tuple[str, str], ...]:
    """Whole licences, from the files named by their SPDX ids; AGPL-3.0 is made from GPL-3.0, which differs in its name and in section 13."""
    files = sorted((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in resources.files(__package__).joinpath("licence_texts").iterdir() if f.name.endswith(".txt"))
    agpl = re.sub(r"(?i)GNU General Public", "GNU Affero General Public", dict(files)["GPL-3.0"])
    return (*files, ("AGPL-3.0", agpl))


TEXTS = _texts()
NOTICE_WORDS = {w for _, text in TEMPLATES for w in words_of(text)}
LONGEST = max(len(words_of(text)) for _, text in TEMPLATES)  # words
VOCABULARY = NOTICE_WORDS.union(*(words_of(text) for _, text in TEXTS))


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many documents each word is, summed over a good part of the task before it leaves; the empty word counts documents."""

    def flush() -> pa.RecordBatch:
        words, counts = list(seen), list(seen.values())
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(counts, pa.int64())], ["word", "n"])

    seen: Counter = Counter()
    for batch in batches:
        seen[""] += len(batch)
        for text in batch.column("text").to_pylist():
            seen.update(set(words_of(text or "")))
            if len(seen) > 1 << 19:
                yield flush()
    yield flush()


def weights_of(rows: DataFrame) -> tuple[dict[str, float], float]:
    """Inverse document frequencies of words (smoothed: 1 for a word of every document), and that of all words rarer than these.

    Counted over all documents and all words. Words in fewer than RARE of the documents weigh as if in just so many, so
    the others are at most the mean number of distinct words in a document over RARE. Should they be more than MOST_WORDS all
    the same (books), the share doubles until they aren't.
    """
    counted = t.staged(rows.select("text").mapInArrow(_frequencies, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "frequencies")
    n_docs = counted.where("word = ''").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    share = RARE
    words = counted.where("word <> ''")
    while (often := words.where(F.col("n") >= share * n_docs)).limit(MOST_WORDS + 1).count() > MOST_WORDS:
        share *= 2
    weight = lambda n: math.log((1 + n_docs) / (1 + max(n, share * n_docs))) + 1
    held = often.toArrow()
    return dict(zip(held.column("word").to_pylist(), map(weight, held.column("n").to_pylist()))), weight(0)


class Templates:
    """Template vectors by the weights of words."""

    def __init__(self, weight: dict[str, float], other: float):
        self.weight, self.other = weight, other
        self.notices: dict[frozenset[str], list] = {}  # by their marks
        for name, text in TEMPLATES:
            self.notices.setdefault(marks(words_of(text)), []).append(self._unit(name, text))
        self.texts = [self._unit(*x) for x in TEXTS]

    def _unit(self, name: str, text: str) -> tuple[str, dict[str, float]]:
        v = {w: c * self.weight.get(w, self.other) for w, c in Counter(words_of(text)).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return name, {w: x / norm for w, x in v.items()}

    def best(self, words: list[str], whole: bool, header: float, named: float, file: float = 0.0) -> tuple[float, str]:
        """Largest cosine to the notices that fit these words (of a whole text, to whole licences too) and its licence, or 0 if none reaches its least; ties go to the name that comes first.

        That least is header for notices without a name, named for those with one, and file for all if the text is whole.
        """
        vocabulary = VOCABULARY if whole else NOTICE_WORDS
        v = {w: c * self.weight.get(w, self.other) for w, c in Counter(words).items()}
        square = sum(x * x for x in v.values())
        known = {w: x for w, x in v.items() if w in vocabulary}
        least = file if whole else min(header, named)
        if not square or sum(x * x for x in known.values()) < (least - 1e-6) ** 2 * square:  # no cosine is above the share of these words in the norm
            return 0.0, ""
        norm, found = math.sqrt(square), marks(words)
        units = [(unit, file if whole else named if wanted else header) for wanted, same in self.notices.items() if fits(found, wanted) for unit in same]
        units += [(unit, file) for unit in self.texts] if whole else []
        scores = [(round(sum(x * unit[w] for w, x in known.items() if w in unit) / norm, 6), name, least) for (name, unit), least in units]
        return min(((score, name) for score, name, least in scores if score >= least), key=lambda s: (-s[0], s[1]), default=(0.0, ""))

    def headers(self, lines: list[list[str]], header: float, named: float) -> dict[str, float]:
        """Licences of notices and their cosines. A notice is a line, or a run of neighbouring lines up to twice as long as the longest template; each line is part of the best run it is in."""
        runs = []
        knows = [not NOTICE_WORDS.isdisjoint(words) for words in lines]
        calls = [any(not CALLED.isdisjoint(marks_of(w)) for w in words) for words in lines]
        for i in range(len(lines)):
            if not knows[i]:
                continue
            count: dict[str, int] = {}
            n, known, square, least = 0, 0.0, 0.0, header
            for j in range(i, len(lines)):
                n += len(lines[j])
                if not lines[j] or (j > i and n > 2 * LONGEST):
                    break
                if calls[j]:
                    least = min(header, named)
                for w in lines[j]:
                    c = count.get(w, 0)
                    count[w] = c + 1
                    x = (2 * c + 1) * self.weight.get(w, self.other) ** 2
                    square += x
                    if w in NOTICE_WORDS:
                        known += x
                if knows[j] and known >= (least - 1e-6) ** 2 * square:
                    score, name = self.best([w for words in lines[i : j + 1] for w in words], False, header, named)
                    if name:
                        runs.append((-score, j - i, i, j, name))
        found: dict[str, float] = {}
        taken: set[int] = set()
        for minus, _, i, j, name in sorted(runs):
            if taken.isdisjoint(range(i, j + 1)):
                taken.update(range(i, j + 1))
                found[name] = max(-minus, found.get(name, 0))
        return found


def _scan(shared, header: float, named: float, file: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = shared.value
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                lines = [words_of(line) for line in (text or "").split("\n")]
                found = templates.headers(lines, header, named)
                top = min(found, key=lambda x: (-found[x], x)) if found else None
                whole = templates.best([w for words in lines for w in words], True, header, named, file)
                rows.append((top, found.get(top, 0.0), sorted(found), whole[1] or None, whole[0]))
            names = [c for c in batch.schema.names if c != "text"]
            kinds = (pa.string(), pa.float64(), pa.list_(pa.string()), pa.string(), pa.float64())
            cols = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(c, k) for c, k in zip(cols, kinds))], [*names, "header", "header_score", "headers", "file", "file_score"])

    return run


def ancestors(directory: Column) -> Column:
    """A directory and all above it, nearest first; the root is the empty string."""
    parts = F.split(directory, "/")
    up = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.array_distinct(F.concat(up, F.array(F.lit(""))))


def licence_scan(docs: DataFrame, header: float = HEADER, named: float = NAMED, file: float = FILE, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """The licence of each document and where it comes from.

    Every line and every run of neighbouring lines is held against the notices that fit it (see fits: a notice of another version
    or variant never does, so that one which isn't known gives none), and every whole text against notices and
    whole licences, by the cosine of TF-IDF vectors whose document frequencies are counted over all words of all documents (see
    weights_of). What can't reach the least cosine is left before it is worked out: a cosine is never above the share of the templates'
    words in the norm. Runs are
    of up to twice as many words as the longest notice has, and end at lines without words. The best line or run whose cosine is at
    least named, for a notice that has a licence's name, or header, for others, is the document's own licence (source header). A text that as a whole reaches file is a licence file, and applies to its directory; of several in
    one directory the one with the best score, then the least path and name, does. Documents without a header take the
    licence of the nearest directory on their path that has one (source inherited), else none (nulls). Names are of a version;
    whether later ones are allowed isn't told.
    Null texts and paths count as empty; rows may repeat. Other columns are ignored.

    Returns doc_id, path, licence, score, source, headers (all licences found in lines) and licence_file.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), F.col(text_col).cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(Templates(*weights_of(rows)))  # MOST_WORDS words at most
    scanned = rows.mapInArrow(_scan(shared, header, named, file), "doc_id long, path string, header string, header_score double, headers array<string>, file string, file_score double")
    directory = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    scanned = t.staged(scanned.withColumn("dir", directory), "scanned")
    best = F.min(F.struct((-F.col("file_score")).alias("minus"), "path", "file")).alias("best")
    given = scanned.where((F.col("file_score") >= file) & F.col("file").isNotNull()).groupBy("dir").agg(best)
    given = given.select("dir", F.col("best.file").alias("licence"), (-F.col("best.minus")).alias("score"))
    dirs = scanned.select("dir").distinct().select("dir", F.posexplode(ancestors(F.col("dir"))).alias("steps", "above"))
    nearest = dirs.join(given.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.min_by(F.struct("licence", "score"), "steps").alias("near"))
    nearest = t.staged(nearest, "nearest")
    out = scanned.join(nearest, "dir", "left")
    own = F.col("header").isNotNull()
    return out.select(
        "doc_id", "path", F.coalesce("header", "near.licence").alias("licence"), F.when(own, F.col("header_score")).otherwise(F.col("near.score")).alias("score"),
        F.when(own, "header").when(F.col("near").isNotNull(), "inherited").alias("source"), "headers", (F.col("file_score") >= file).alias("licence_file"),
    )
