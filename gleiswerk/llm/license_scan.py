"""License scans: sparse TF-IDF cosine of headers to licence templates, and inheritance from the nearest directory.

Terms are weighed by their document frequency over all files (one count of the
templates' vocabulary, so bounded). Every line of every file, and every run of
lines as long as a template may be when it is wrapped (as many lines as it has
words), is compared with the templates by the cosine of sparse TF-IDF vectors.
By the inequality of Cauchy and Schwarz a cosine is at most the length of the
template's part that the text has any term of; files and runs in which that is
below MIN_SCORE are left out without loss. The best one of at least MIN_SCORE
is the file's declared licence, if the text has the numbers and the telling
words of that template (``lesser``, ``3``) and none that tell of a sibling. A licence file (by its name, or a file that is
hardly more than its licence) declares for its directory; files that declare
nothing inherit from the nearest directory above them. That is a join of paths:
each directory is expanded to its ancestors once, however many files it has.

Defined results: a null text has no terms; a null path has no directory and
inherits nothing. Ties go to the higher score, then the first licence by name.
Rows with one id are scanned each for itself; an empty table gives an empty
one. A text is one value of one task, however long. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, record_batch, table

MIN_SCORE = 0.7
#: A file of at most this many words besides its licence is a licence file.
FILE_WORDS = 40
#: How headers, notices and licence files state well-known licences.
GNU = "under the terms of the GNU {0} as published by the Free Software Foundation"
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
    ),
    "ISC": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        f"This program is free software: you can redistribute it and/or modify it {GNU.format('General Public License')}, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", f"This program is free software; you can redistribute it and/or modify it {GNU.format('General Public License')}; version 2.", "SPDX-License-Identifier: GPL-2.0-only"),
    "GPL-2.0-or-later": (
        f"This program is free software; you can redistribute it and/or modify it {GNU.format('General Public License')}; either version 2 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-2.0-or-later",
    ),
    "LGPL-2.1": (
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        f"This library is free software; you can redistribute it and/or modify it {GNU.format('Lesser General Public License')}; either version 2.1 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "LGPL-3.0": (
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        f"This library is free software; you can redistribute it and/or modify it {GNU.format('Lesser General Public License')}; either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: LGPL-3.0-only",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        f"This program is free software: you can redistribute it and/or modify it {GNU.format('Affero General Public License')}, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: AGPL-3.0-only",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
}
_TERM = re.compile(r"[^\W_]+(?:\.\d+)*")
_NAMED = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)([.-][^/]*)?$"


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


#: Words that one licence of a family has and its siblings don't; and those that name a licence.
SIBLINGS = frozenset("lesser affero noncommercial sharealike endorse".split())
NAMING = SIBLINGS | frozenset("nc sa isc mit apache bsd mozilla".split())
VOCABULARY = frozenset(t for group in TEMPLATES.values() for x in group for t in terms(x))


def term_counts(files: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of files, and in how many of them each term of the templates is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            count[""] += batch.num_rows
            for text in batch.column(0):
                count.update(VOCABULARY.intersection(terms(text.as_py() or "")))
        yield record_batch(pa.schema([("term", pa.string()), ("n", pa.int64())]), [list(count), list(count.values())])

    rows = files.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r.term: r.n for r in rows.collect()}  # a row for each term of the templates at most
    return found.pop("", 0), found


class Templates:
    """The templates as unit vectors of TF-IDF weights."""

    def __init__(self, n_files: int, df: dict[str, int]):
        self.idf = {t: math.log((1 + n_files) / (1 + df.get(t, 0))) + 1 for t in VOCABULARY}
        self.unseen = math.log(1 + n_files) + 1  # terms of no template weigh as rare ones
        found = [(name, terms(x)) for name in sorted(TEMPLATES) for x in TEMPLATES[name]]
        self.names = [name for name, _ in found]
        self.words = [len(x) for _, x in found]
        #: Numbers, and words that tell sibling licences apart: a text without them isn't under the template's licence.
        self.needed = [{t for t in x if t[0].isdigit() or t in NAMING} for _, x in found]
        #: Of each term: the templates that have it, and its weights there.
        self.of_term: dict[str, list[tuple[int, float]]] = {}
        for k, (_, x) in enumerate(found):
            for t, w in self.vector(x).items():
                self.of_term.setdefault(t, []).append((k, w))

    def vector(self, found: list[str]) -> dict[str, float]:
        weights = {t: n * self.idf.get(t, self.unseen) for t, n in Counter(found).items()}
        norm = math.sqrt(sum(w * w for w in weights.values())) or 1.0
        return {t: w / norm for t, w in weights.items()}

    def within_reach(self, present: set[str] | frozenset[str]) -> set[int]:
        """Templates whose cosine with a text of these terms may reach MIN_SCORE."""
        most: dict[int, float] = {}
        for t in present:
            for k, w in self.of_term[t]:
                most[k] = most.get(k, 0.0) + w * w
        return {k for k, x in most.items() if x >= MIN_SCORE**2 - 1e-9}

    def fits(self, k: int, counts: Counter) -> bool:
        """Whether a text has the numbers and naming words of template k, and no word of a sibling besides."""
        return all(counts[t] for t in self.needed[k]) and not any(counts[t] for t in SIBLINGS - self.needed[k])

    def best(self, text: str) -> tuple[str | None, float, int]:
        """Licence, score and words of the line, or the run of lines, that is most like a template."""
        found: tuple[str | None, float, int] = (None, 0.0, 0)
        if not self.within_reach(VOCABULARY.intersection(terms(text))):
            return found
        lines = [x for line in text.split("\n") if (x := terms(line))]
        has = [VOCABULARY.intersection(x) for x in lines]
        for i in range(len(lines)):
            if not has[i]:
                continue
            live = self.within_reach(frozenset().union(*has[i : i + max(self.words)]))
            if not live:
                continue
            counts: Counter = Counter()
            dot = dict.fromkeys(sorted(live), 0.0)
            square, n = 0.0, 0
            for j in range(i, min(len(lines), i + max(self.words[k] for k in live))):
                for t in lines[j]:
                    idf = self.idf.get(t, self.unseen)
                    square += idf * idf * (2 * counts[t] + 1)
                    counts[t] += 1
                    for k, w in self.of_term.get(t, ()):
                        if k in dot:
                            dot[k] += idf * w
                n += len(lines[j])
                if has[j]:
                    norm = math.sqrt(square)
                    for k, x in dot.items():
                        score = x / norm
                        if score >= MIN_SCORE and score > found[1] + 1e-12 and j - i < self.words[k] and self.fits(k, counts):
                            found = (self.names[k], min(1.0, score), n)
        return found


def declared(files: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id, path, declared (null: none), score, licence_file of each file (columns id, path, text)."""
    n, df = term_counts(files)
    shared = files.sparkSession.sparkContext.broadcast(Templates(n, df))
    schema = pa.schema([(id_column, pa.int64()), ("path", pa.string()), ("declared", pa.string()), ("score", pa.float64()), ("short", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name, score, short = [], [], []
            for text in batch.column(2):
                text = text.as_py() or ""
                a, b, words = shared.value.best(text)
                name.append(a)
                score.append(round(b, 6))
                short.append(a is not None and len(terms(text)) <= FILE_WORDS + words)
            yield record_batch(schema, [batch.column(0), batch.column(1), name, score, short])

    rows = files.select(F.col(id_column).cast("long").alias(id_column), F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(run, f"{id_column} long, path string, declared string, score double, short boolean")
    return found.withColumn("licence_file", F.col("declared").isNotNull() & (F.col("short") | F.coalesce(F.col("path").rlike(_NAMED), F.lit(False)))).drop("short")


def with_inherited(found: DataFrame) -> DataFrame:
    """``declared`` rows with dir, inherited_from, and licence: declared, else of the nearest directory at or above the file's."""
    files = found.withColumn("dir", F.regexp_replace("path", "/?[^/]*$", ""))
    of_dir = (
        files.where("licence_file and dir is not null").groupBy("dir")
        .agg(F.min_by("declared", F.struct(-F.col("score"), F.col("declared"))).alias("dir_licence")).withColumnRenamed("dir", "above")
    )
    parts = F.split("dir", "/")
    dirs = files.where("dir is not null").select("dir").distinct()
    above = dirs.withColumn("n", F.explode(F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(parts))))).select("dir", "n", F.array_join(F.slice(parts, F.lit(1), F.col("n")), "/").alias("above"))
    nearest = above.join(of_dir, "above").groupBy("dir").agg(F.max_by(F.struct("above", "dir_licence"), "n").alias("got"))
    nearest = nearest.select("dir", F.col("got.above").alias("inherited_from"), F.col("got.dir_licence").alias("inherited"))
    out = files.join(nearest, "dir", "left")
    own = F.col("declared").isNotNull()
    return out.withColumn("inherited_from", F.when(~own, F.col("inherited_from"))).withColumn("licence", F.coalesce("declared", "inherited")).drop("inherited")


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: source, language and a directory of a hundred ids are the path."""
    part = F.floor(F.col("doc_id") / 100).cast("string")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.coalesce(part, F.lit("none")), F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt")))
    return docs.select("doc_id", path.alias("path"), "text")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_inherited(materialize(declared(document_paths(table(spark, sf_dir, "documents"))), "declared"))  # read four times
    return found.select("doc_id", "path", "declared", "score", "licence_file", "inherited_from", "licence")
