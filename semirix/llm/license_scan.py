"""Licences: TF-IDF cosine of lines and whole files to templates, then inheritance from the nearest directory above.

Words are runs of letters and digits, in lower case. The document frequencies of the templates' words are counted over all
files; a word of no template has the greatest weight there is, so foreign words in a line lower its cosine. Every line of a
file is a possible header, and so is each run of lines that is about as long as a template, as headers are wrapped: from each line
on, the longest run of at most its words and the shortest of at least its words. A file as a whole is a licence file if its name says
so, or if its whole text is close to a template; the templates are the usual notices, the full text of short licences, and the title
and first sentence of long ones. A file's own licence is its best line's, run's or its whole text's, at ``threshold`` or more. The
other files inherit from the nearest directory above them that has a licence file: each different directory is joined with its
ancestors' licences once, and the files then with their directory, so a directory that holds a third of the files costs one small
row in the first join and is split by AQE in the second. The root, above all, is looked up as one row and joins nothing.

Defined results: a null or empty text has no licence of its own; a null path has no directory and inherits nothing. Several
licence files in a directory: the closest counts, then the first path. Equal cosines: the template first in order. Repeated rows are
scanned each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semirix.llm._store import table
from semirix.llm._text import Words, blocks

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED'
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_END = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE '
    "ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
# Licence names, the sentences by which files state them, and the texts of licence files.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        f"this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
        "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_VERBATIM}"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. {_VERBATIM}"),
    ("LGPL-3.0", f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_VERBATIM}"),
    ("AGPL-3.0", f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_VERBATIM}"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.{_BSD_END}"),
    ("BSD-2-Clause", _BSD + _BSD_END),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        'PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    ),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("all-rights-reserved", "All rights reserved."),
)
FILES = r"(?i)(^|/)(licen[cs]e|copying|copyright|unlicense|notice)([._-][^/]*)?$"
_INK = np.zeros(256, bool)
_INK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass
class TemplateIndex:
    """Sorted word hashes of all templates, and the templates' words and counts."""

    names: list[str]
    vocabulary: np.ndarray
    counts: np.ndarray  # [words, templates]
    idf: np.ndarray | None = None
    top: float = 1.0
    unit: np.ndarray | None = None

    def weigh(self, df: np.ndarray, files: int) -> TemplateIndex:
        """Weights from the number of files with each word and of all files."""
        self.idf = np.log((files + 1) / (df + 1)) + 1
        self.top = float(np.log(files + 1) + 1)
        w = self.counts * self.idf[:, None]
        self.unit = w / np.sqrt((w * w).sum(axis=0))
        return self

    def place(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.vocabulary, hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == hashes, at, -1)

    def cosines(self, at: np.ndarray, unit: np.ndarray, units: int) -> np.ndarray:
        """[units, templates]; at: each word's place (-1: in no template), unit: which line or text it is in."""
        known = at >= 0
        size = len(self.vocabulary)
        key, tf = np.unique(unit[known].astype(np.int64) * size + at[known], return_counts=True)
        owner, word = key // size, key % size
        w = tf * self.idf[word]
        norm = np.bincount(owner, w * w, units) + np.bincount(unit[~known], minlength=units) * self.top**2
        out = np.stack([np.bincount(owner, w * self.unit[word, t], units) for t in range(self.unit.shape[1])], axis=1)
        return out / np.sqrt(np.maximum(norm, 1e-12))[:, None]


    def runs(self, at: np.ndarray, first: np.ndarray, owner: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of two or more lines that can reach a cosine of ``least`` (of their text): first line, cosine, template.

        at: each word's place; first: the n + 1 offsets of the lines in it; owner: the lines' texts, ascending.
        """
        known = at >= 0
        weight = np.where(known, self.idf[np.maximum(at, 0)], self.top)
        mass = np.concatenate([[0.0], np.cumsum(weight * weight)])  # of a run: at most its squared norm, as counts are 1 at least
        n = len(owner)
        line, last = np.arange(n), np.searchsorted(owner, owner, "right")
        found = []
        for t in range(self.unit.shape[1]):
            size = int(self.counts[:, t].sum())
            gain = np.where(known, weight * self.unit[np.maximum(at, 0), t], 0.0)
            dot = np.concatenate([[0.0], np.cumsum(gain)])
            longest = np.searchsorted(first, first[:-1] + size, "right") - 1  # behind its last line
            for end in (longest, np.where(first[longest] - first[:-1] < size, longest + 1, longest)):
                end = np.minimum(end, last)
                s = line[end - line >= 2]
                a, b = first[s], first[end[s]]
                s = s[dot[b] - dot[a] >= least[owner[s]] * np.sqrt(np.maximum(mass[b] - mass[a], 0.0)) - 1e-6]
                found.append(s * np.int64(n + 1) + end[s])
        pairs = np.unique(np.concatenate(found))
        score, which = np.zeros(len(pairs)), np.zeros(len(pairs), np.int64)
        begin, end = pairs // (n + 1), pairs % (n + 1)
        for i in range(0, len(pairs), 4096):  # bounds the words of a step
            a, size = first[begin[i : i + 4096]], first[end[i : i + 4096]] - first[begin[i : i + 4096]]
            words = np.arange(size.sum()) + np.repeat(a - np.cumsum(size) + size, size)
            cos = self.cosines(at[words], np.repeat(np.arange(len(a)), size), len(a))
            score[i : i + 4096], which[i : i + 4096] = cos.max(axis=1), cos.argmax(axis=1)
        return begin, score, which


def index(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> TemplateIndex:
    w = Words(pa.array([t for _, t in templates]), _INK)
    vocabulary, inv = np.unique(w.hashes(lower=True), return_inverse=True)
    counts = np.zeros((len(vocabulary), len(templates)))
    np.add.at(counts, (inv, np.repeat(np.arange(w.n), w.counts)), 1)
    return TemplateIndex([n for n, _ in templates], vocabulary, counts)


def frequencies(files: DataFrame, own: TemplateIndex, text_col: str) -> tuple[np.ndarray, int]:
    """Files with each template word, and all files."""

    def run(batches):
        df, n = np.zeros(len(own.vocabulary), np.int64), 0
        for b in blocks(batches):
            w = Words(b.column("text"), _INK)
            at = own.place(w.hashes(lower=True))
            text = np.repeat(np.arange(w.n), w.counts)
            hit = np.unique(text[at >= 0] * len(df) + at[at >= 0])
            df += np.bincount(hit % len(df), minlength=len(df))
            n += w.n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(df))), pa.array(np.concatenate([[n], df]))], ["word", "n"])

    rows = files.select(F.col(text_col).alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"]: r["n"] for r in rows}  # the templates' vocabulary at most
    return np.array([found.get(i, 0) for i in range(len(own.vocabulary))]), found.get(-1, 0)


def own_licenses(files: DataFrame, own: TemplateIndex, id_col: str, text_col: str, path_col: str, threshold: float, whole: float) -> DataFrame:
    """id, path, license, score, line (the first of a run; -1: the whole text; null: none), whole_license, whole_score."""
    kind = files.schema[id_col].dataType.simpleString()
    names = np.array(own.names, object)

    def run(batches):
        for b in blocks(batches):
            w = Words(b.column("text"), _INK)
            at, text = own.place(w.hashes(lower=True)), np.repeat(np.arange(w.n), w.counts)
            line = np.cumsum(w.data == 10)[w.starts] if len(w.starts) else np.zeros(0, np.int64)
            base = np.concatenate([[0], np.cumsum(w.data == 10)])[w.offs[:-1]]
            unit = line + text  # a new text is a new line
            full = own.cosines(at, text, w.n)
            best, kept, where = full.argmax(axis=1), full.max(axis=1, initial=0.0), np.full(w.n, -1, np.int64)
            whole_name, whole_score = names[best].copy(), kept.copy()
            if len(unit):
                u, first = np.unique(unit, return_index=True)
                lines = own.cosines(at, np.searchsorted(u, unit), len(u))
                top, which, owner = lines.max(axis=1), lines.argmax(axis=1), text[first]
                order = np.lexsort((first, -top, owner))
                lead = order[np.r_[True, np.diff(owner[order]) > 0]]
                better = top[lead] >= kept[owner[lead]]
                d = owner[lead][better]
                kept[d], best[d], where[d] = top[lead][better], which[lead][better], (line[first] - base[owner])[lead][better]
                s, score, which = own.runs(at, np.append(first, len(unit)), owner, np.maximum(threshold, kept))
                order = np.lexsort((s, -score, owner[s]))
                lead = order[np.r_[True, np.diff(owner[s][order]) > 0]] if len(order) else order
                lead = lead[score[lead] > kept[owner[s[lead]]] + 1e-9]
                d = owner[s[lead]]
                kept[d], best[d], where[d] = score[lead], which[lead], (line[first] - base[owner])[s[lead]]
            ok = kept >= threshold
            text_or = lambda v, m: pa.array([x if y else None for x, y in zip(v, m, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("path"), text_or(names[best], ok), pa.array(kept), pa.array(np.where(ok, where, 0), mask=~ok), text_or(whole_name, whole_score >= whole), pa.array(whole_score)],
                ["id", "path", "license", "score", "line", "whole_license", "whole_score"],
            )

    rows = files.select(F.col(id_col).alias("id"), F.col(path_col).cast("string").alias("path"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, path string, license string, score double, line long, whole_license string, whole_score double")


def scan(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = 0.7, whole: float = 0.5, id_col: str = "doc_id", text_col: str = "text", path_col: str = "path") -> DataFrame:
    """id, path, license, score, line, via ('header', 'file', 'inherited' or null), from_directory: a row for each file."""
    own = index(templates)
    own.weigh(*frequencies(files, own, text_col))
    found = table(own_licenses(files, own, id_col, text_col, path_col, threshold, whole), "licenses")
    found = found.withColumn("directory", F.regexp_replace("path", "/?[^/]*$", ""))
    named = F.col("path").rlike(FILES) & F.col("license").isNotNull()
    of_file = F.coalesce(F.col("whole_license"), F.when(named, F.col("license")))
    holders = found.filter(of_file.isNotNull() & F.col("directory").isNotNull())
    best = holders.groupBy("directory").agg(F.min_by(F.struct(of_file.alias("license"), F.greatest("whole_score", "score").alias("score")), F.struct(-F.greatest("whole_score", "score"), F.col("path"))).alias("best"))
    best = best.select(F.col("directory").alias("above"), F.col("best.license").alias("up_license"), F.col("best.score").alias("up_score"))
    root = best.filter("above = ''").select(F.col("up_license").alias("root_license"), F.col("up_score").alias("root_score"))  # one row, or none
    places = found.filter(F.col("license").isNull() & F.col("directory").isNotNull()).select("directory").distinct()
    parts = F.split("directory", "/")
    chain = places.select("directory", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), "/").alias("above")))).alias("a")).select("directory", "a.depth", "a.above")
    nearest = chain.join(best, "above").groupBy("directory").agg(F.max_by(F.struct("above", "up_license", "up_score"), "depth").alias("up")).select("directory", "up.*")
    top = root.agg(F.first("root_license").alias("root_license"), F.first("root_score").alias("root_score"))
    out = found.join(nearest, "directory", "left").join(F.broadcast(top))
    from_root = F.col("up_license").isNull() & F.col("directory").isNotNull() & F.col("root_license").isNotNull()
    for name, value in (("above", F.lit("")), ("up_score", F.col("root_score")), ("up_license", F.col("root_license"))):
        out = out.withColumn(name, F.when(from_root, value).otherwise(F.col(name)))
    none = F.col("license").isNull()
    return out.select(
        F.col("id").alias(id_col), "path", F.when(none, F.col("up_license")).otherwise(F.col("license")).alias("license"), F.when(none, F.col("up_score")).otherwise(F.col("score")).alias("score"), "line",
        F.when(none & F.col("up_license").isNotNull(), F.lit("inherited")).when(none, F.lit(None)).when(F.col("line") < 0, F.lit("file")).otherwise(F.lit("header")).alias("via"),
        F.when(none & F.col("up_license").isNotNull(), F.col("above")).alias("from_directory"),
    )
