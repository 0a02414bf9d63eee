"""Licence scans: sparse TF-IDF cosines to licence templates, then inheritance from the nearest ancestor directory.

Templates are notices (TEMPLATES) and whole licence texts (licence_texts/). Terms are word unigrams and bigrams (A-Z
folded) of the templates. Inverse document frequencies count every file of the table. Each line of a file, each
paragraph (lines with words up to one without, so that a comment block's empty lines part it), and the file as a whole
become sparse vectors; the best cosine with a template, if at least `least`, is the file's own licence ("header", or
"file" where the whole text is a licence). A cosine can't exceed the share of a vector that lies on the templates'
terms, so only units where that share suffices are multiplied out.

A file that is a licence as a whole, or is named like one, licenses its directory; every file without a licence of its
own inherits that of its nearest ancestor directory that has one, through joins on path prefixes.

Nulls: a null text holds no terms, a null path has no directory (its file keeps its own licence only). Ties between
templates go to the name that sorts first; between licence files of a directory, to the higher cosine, then the name,
then the path. Repeated rows are files of their own; very long texts are read whole; empty tables give empty results;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bytesnp as B
from tidemark.llm.store import Scratch

# The notices by which public licences are declared.
TEMPLATES = {
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Proprietary": ["All rights reserved."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)[^/]*$"
#: Terms of units that are multiplied with all templates at a time.
TERMS = 1 << 15
#: Directories whose licences may be broadcast.
MANY = 100_000


def licence_templates() -> dict[str, list[str]]:
    """The notices and, by name of their file, the whole texts."""
    texts = {p.stem: p.read_text("utf-8") for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}
    return {name: TEMPLATES.get(name, []) + ([texts[name]] if name in texts else []) for name in sorted({*TEMPLATES, *texts})}


class Words:
    """Hashes of a chunk's words, and of each word with the one before it; units are where lines, paragraphs or rows begin."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.start, end, _ = B.words(buf, off, B.GAP)
        h = B.spans_hash(B.prefix(buf, B.FOLDED), self.start, end)
        self.hash = np.concatenate([h, B.mix(h[:-1] * B.U(B.BASE) + h[1:] + B.U(2))])
        self.rows = off[:-1]
        self.lines = np.unique(np.concatenate([off[:-1], np.flatnonzero(buf == 10) + 1]))
        filled = np.diff(np.append(np.searchsorted(self.start, self.lines), len(self.start))) > 0
        opens = filled & ~np.concatenate([[False], filled[:-1]])
        self.paragraphs = np.unique(np.concatenate([off[:-1], self.lines[opens]]))

    def units(self, at: np.ndarray) -> np.ndarray:
        """Unit of each term; -1 for a pair that no unit holds whole."""
        own = np.searchsorted(at, self.start, "right") - 1
        return np.concatenate([own, np.where(own[1:] == own[:-1], own[1:], -1)])


class Index:
    """Templates as unit vectors over their terms."""

    def __init__(self, templates: dict[str, list[str]]):
        flat = sorted((name, text.encode()) for name, texts in templates.items() for text in texts)
        self.names = [name for name, _ in flat]
        off = np.concatenate([[0], np.cumsum([len(t) for _, t in flat])]).astype(np.int64)
        w = Words(np.frombuffer(b"".join(t for _, t in flat), np.uint8), off)
        own = w.units(w.rows)
        self.keys, back = np.unique(w.hash[own >= 0], return_inverse=True)
        self.counts = np.zeros((len(flat), len(self.keys)))
        np.add.at(self.counts, (own[own >= 0], back), 1)

    def weigh(self, idf: np.ndarray, foreign: float) -> None:
        """foreign: weight of each word or pair that no template has."""
        self.idf, self.foreign = idf, foreign
        x = (1 + np.log(np.maximum(self.counts, 1))) * (self.counts > 0) * idf
        self.matrix = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).T.copy()

    def slots(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == h, at, -1)

    def best(self, slot: np.ndarray, own: np.ndarray, n_units: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Units with at least two terms and a cosine of at least `least`; their best template and its cosine."""
        held = own >= 0
        apart = np.bincount(own[held & (slot < 0)], minlength=n_units)
        name, tf = np.unique(own[held & (slot >= 0)] * len(self.keys) + slot[held & (slot >= 0)], return_counts=True)
        unit, term = name // len(self.keys), name % len(self.keys)
        weight = (1 + np.log(tf)) * self.idf[term]
        inside = np.bincount(unit, weight * weight, n_units)
        norm = np.sqrt(inside + apart * self.foreign**2)
        hits = np.bincount(unit, tf, n_units)
        go = (hits >= 2) & (inside >= (least * norm) ** 2)
        mine = go[unit]
        unit, term, weight = unit[mine], term[mine], weight[mine]
        begin = np.append(np.flatnonzero(np.diff(unit, prepend=-1)), len(unit))
        units, tops, cosines, lo = [], [], [], 0
        while lo < len(begin) - 1:
            hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + TERMS, "right")) - 1)
            a, z = begin[lo], begin[hi]
            product = np.add.reduceat(self.matrix[term[a:z]] * weight[a:z, None], begin[lo:hi] - a, axis=0)
            cosine = product / norm[unit[begin[lo:hi]], None]
            units.append(unit[begin[lo:hi]])
            tops.append(cosine.argmax(axis=1))
            cosines.append(cosine.max(axis=1))
            lo = hi
        if not units:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        unit, top, cosine = np.concatenate(units), np.concatenate(tops), np.concatenate(cosines)
        ok = cosine >= least
        return unit[ok], top[ok], cosine[ok]


def _frequencies(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(index.keys), np.int64), 0
        for batch in batches:
            for _, _, b, o in B.pieces(*B.column(batch, "text")):
                w = Words(b, o)
                # A pair of words on two lines or more is a term of paragraphs and of the whole.
                slot, row = index.slots(w.hash), w.units(w.rows)
                ok = (slot >= 0) & (row >= 0)
                seen = np.unique(row[ok] * len(index.keys) + slot[ok])
                total += np.bincount(seen % len(index.keys), minlength=len(index.keys))
            n += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], n), pa.int64())], names=["term", "n"])

    return run


def _scan(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            name: list = [None] * batch.num_rows
            cosine, whole = np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            for i, _, b, o in B.pieces(*B.column(batch, "text")):
                if not len(b):
                    continue
                w = Words(b, o)
                slot = index.slots(w.hash)
                for at in (w.lines, w.paragraphs, w.rows):
                    unit, top, value = index.best(slot, w.units(at), len(at), least)
                    row = i + np.searchsorted(o, at[unit], "right") - 1
                    for r, t, c in zip(row.tolist(), top.tolist(), value.tolist(), strict=True):
                        # The whole text, where it is a licence, decides over its lines and paragraphs.
                        whole[r] |= at is w.rows
                        if at is w.rows or c > cosine[r] + 1e-12:
                            cosine[r], name[r] = c, index.names[t]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(name, pa.string()), pa.array(cosine), pa.array(whole)], names=["doc_id", "path", "own", "cosine", "whole"])

    return run


def parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.when(path != "", ""))


def scan(files: DataFrame, least: float = 0.6, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """files (doc_id, path, text) -> (doc_id, path, license, cosine, found: header, file, inherited or null, licensed_by: a directory)."""
    spark = files.sparkSession
    scratch = Scratch(spark, "licenses")
    kind = dict(files.dtypes)["doc_id"]
    rows = files.select("doc_id", F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    index = Index(templates or licence_templates())
    counted = {r["term"]: r["n"] for r in rows.select("text").mapInArrow(_frequencies(index), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    n = counted.pop(-1, 0)
    index.weigh(np.array([np.log((1 + n) / (1 + counted.get(k, 0))) + 1 for k in range(len(index.keys))]), float(np.log(1 + n) + 1))
    shared = spark.sparkContext.broadcast(index)
    own = scratch.cut(rows.mapInArrow(_scan(shared, least), f"doc_id {kind}, path string, own string, cosine double, whole boolean"))
    at = own.where("own is not null and path is not null").where(F.col("whole") | F.col("path").rlike(LICENCE_FILE))
    at = at.withColumn("dir", parent(F.col("path"))).groupBy("dir").agg(F.min_by(F.struct("own", "cosine"), F.struct(-F.col("cosine"), "own", "path")).alias("x")).select("dir", F.col("x.own").alias("dir_license"), F.col("x.cosine").alias("dir_cosine"))
    alone = F.col("own").isNull() & F.col("path").isNotNull()
    bare = own.where(alone).withColumn("from", parent(F.col("path")))
    # Every directory of an unlicensed file with all its ancestors; the deepest licensed one is the nearest.
    parts = F.split("from", "/")
    ups = bare.select("from").distinct().select("from", F.explode(F.sequence(F.lit(0), F.when(F.col("from") == "", 0).otherwise(F.size(parts)))).alias("depth")).select("from", "depth", F.array_join(F.slice(F.split("from", "/"), F.lit(1), F.col("depth")), "/").alias("dir"))
    nearest = scratch.cut(ups.join(at, "dir").groupBy("from").agg(F.max_by(F.struct("dir", "dir_license", "dir_cosine"), "depth").alias("n")).select("from", "n.*"))
    if nearest.count() <= MANY:
        nearest = F.broadcast(nearest)
    heirs = bare.join(nearest, "from", "left").select("doc_id", "path", F.col("dir_license").alias("license"), F.col("dir_cosine").alias("cosine"), F.when(F.col("dir_license").isNotNull(), "inherited").alias("found"), F.col("dir").alias("licensed_by"))
    owners = own.where(~alone).select("doc_id", "path", F.col("own").alias("license"), F.when(F.col("own").isNotNull(), F.col("cosine")).alias("cosine"), F.when(F.col("own").isNotNull(), F.when(F.col("whole"), "file").otherwise("header")).alias("found"), F.lit(None).cast("string").alias("licensed_by"))
    return owners.unionByName(heirs)
