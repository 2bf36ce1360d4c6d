"""Licence scans over a positional index of rare words."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoweave.session import read_table, small_batches

# Label, mandatory key phrase, and a public notice in which it stands.
BASE = [
    ("cc-by", "cc by", "This work is licensed under the Creative Commons Attribution 4.0 International License (CC BY 4.0). To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"),
    ("gpl", "general public license", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("reserved", "all rights reserved", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means, including photocopying, recording, or other electronic or mechanical methods, without the prior written permission of the publisher"),
]
NOTICES = [
    ("agpl", "gnu affero general public license", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("apache-2.0", "apache license version 2 0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("artistic", "artistic license", "This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License, or under the same terms as Perl itself."),
    ("boost", "boost software license", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("bsd", "redistribution and use in source and binary forms", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "bsd license", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file. Released under the BSD License"),
    ("cc-by-nc", "cc by nc", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "cc by nd", "This work is licensed under the Creative Commons Attribution-NoDerivatives 4.0 International License. Licensed under CC BY-ND 4.0"),
    ("cc-by-sa", "cc by sa", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. Licensed under CC BY-SA 4.0"),
    ("cc0", "cc0 1 0 universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal public domain dedication"),
    ("creative-commons", "creative commons attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("eclipse", "eclipse public license", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("gpl-2.0", "general public license version 2", "under the terms of the GNU General Public License, version 2, as published by the Free Software Foundation"),
    ("gpl-3.0", "general public license version 3", "This work is licensed under the GNU General Public License, version 3."),
    ("isc", "permission to use copy modify and or distribute this software", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("lgpl", "gnu lesser general public license", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("mit", "mit license", "Released under the MIT License."),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mpl-2.0", "mozilla public license", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("proprietary", "proprietary and confidential", "Unauthorized copying of this file, via any medium is strictly prohibited. Proprietary and confidential"),
    ("unlicense", "free and unencumbered software", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("zlib", "provided as is without any express or implied warranty", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
]

#: Of each notice, so many of its words with the highest inverse document frequency are looked up, and so many must agree.
RARE_WORDS, AGREEING = 6, 2
#: Of each key phrase, which may stand alone, so many; all of them must agree.
PHRASE_WORDS = 2

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


class Template:
    """A row of words to be found: a whole notice, or its key phrase alone. `at` is where the key phrase stands in it."""

    def __init__(self, label: str, phrase: str, notice: str, base: bool, alone: bool) -> None:
        self.label, self.base, self.alone = label, base, alone
        self.phrase, whole = words_of(phrase), words_of(notice)
        n = len(self.phrase)
        self.words = self.phrase if alone else whole
        self.at = next(i for i in range(len(self.words) - n + 1) if self.words[i : i + n] == self.phrase)
        self.share = n / len(whole)


def templates_of(base: list[tuple[str, str, str]], notices: list[tuple[str, str, str]]) -> list[Template]:
    """Each row's notice and its key phrase alone."""
    rows = [(*row, flag) for rows, flag in ((base, True), (notices, False)) for row in rows]
    return [Template(*row, alone) for row in rows for alone in (True, False)]


TEMPLATES = templates_of(BASE, NOTICES)


def document_frequencies(docs: DataFrame, text: str = "text", templates: list[Template] | None = None) -> dict[bytes, int]:
    """In how many documents each word of the notices occurs, over all documents; as many numbers as there are such words."""
    vocabulary = {w for t in templates or TEMPLATES for w in t.words}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                seen.update(vocabulary.intersection(words_of(value.as_py())))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.binary()), "n": pa.array(list(seen.values()), pa.int64())})

    counted = docs.select(F.col(text)).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in counted.collect()}


def coverage(notice: list[bytes], words: list[bytes], offset: int) -> float:
    """The share of a notice's words that a text has in place if the notice begins at its word `offset`, which may be below 0."""
    low = max(0, -offset)
    return sum(a == b for a, b in zip(notice[low:], words[offset + low : offset + len(notice)], strict=False)) / len(notice)


class Index:
    """Postings (template, position in it) of each template's rarest words over the corpus, and how many must agree on a place."""

    def __init__(self, frequencies: dict[bytes, int], rare: int = RARE_WORDS, templates: list[Template] | None = None) -> None:
        self.templates = templates or TEMPLATES
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed: list[int] = []
        for number, t in enumerate(self.templates):
            places: dict[bytes, list[int]] = defaultdict(list)
            for i, w in enumerate(t.words):
                places[w].append(i)
            chosen = sorted(places, key=lambda w: (frequencies.get(w, 0), w))[: PHRASE_WORDS if t.alone else rare]
            for w in chosen:
                self.postings[w] += [(number, i) for i in places[w]]
            count = sum(len(places[w]) for w in chosen)
            self.needed.append(count if t.alone else min(AGREEING, count))
        self.words = frozenset(self.postings)
        self.notices: dict[tuple, list[Template]] = defaultdict(list)
        for t in self.templates:
            if not t.alone:
                self.notices[t.label, t.base, tuple(t.phrase)].append(t)

    def find(self, words: list[bytes]) -> list[tuple[str, int, float, bool]]:
        """(label, word at which the key phrase starts, share of the notice's words in place around it, base), in order.

        The text's rare words are looked up; a posting's position and the word's give the offset at which the template
        would stand. At offsets that enough of a template's rare words agree on, the mandatory key phrase is compared. A key
        phrase without its notice has about its own share of the notice's words.
        """
        votes: Counter = Counter()
        for i, w in enumerate(words):
            if w in self.words:
                for number, at in self.postings[w]:
                    votes[number, i - at] += 1
        best: dict[tuple[str, int, bool], float] = {}
        for (number, offset), n in votes.items():
            t = self.templates[number]
            start = offset + t.at
            if n < self.needed[number] or start < 0 or words[start : start + len(t.phrase)] != t.phrase:
                continue
            around = self.notices[t.label, t.base, tuple(t.phrase)] if t.alone else [t]
            shares = [coverage(notice.words, words, start - notice.at) for notice in around]
            key = t.label, start, t.base
            best[key] = max([t.share, *shares, best.get(key, 0.0)])
        return sorted((label, start, share, base) for (label, start, base), share in best.items())


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rare: int = RARE_WORDS, templates: list[Template] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_words and notices, an array of (label, word, coverage, base).

    Every place of every key phrase is found: its rare words are among those that are looked up, whatever their
    frequency. coverage is 1 where the whole notice stands around the phrase. A null text has no words; a null doc_id
    passes through; rows that repeat an id give a row each; other columns are not read.
    """
    small_batches(docs.sparkSession)
    index = Index(document_frequencies(docs, text, templates), rare, templates)
    kind = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("coverage", pa.float64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, rows = [], []
            for value in batch.column(1):
                words = words_of(value.as_py())
                sizes.append(len(words))
                hits = [] if index.words.isdisjoint(words) else sorted(index.find(words), key=lambda hit: (hit[1], hit[0]))
                rows.append([dict(zip(("label", "word", "coverage", "base"), hit, strict=True)) for hit in hits])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(rows, kind)], ["doc_id", "n_words", "notices"])

    wanted = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return wanted.mapInArrow(run, "doc_id long, n_words long, notices array<struct<label:string,word:long,coverage:double,base:boolean>>")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score is the largest share of a notice that stands around a key phrase; 0 without one. Null texts count as empty."""
    found = scan_licenses(read_table(spark, sf_dir, "documents"))
    base = F.filter("notices", lambda n: n["base"])
    labels = lambda column: F.array_join(F.array_sort(F.array_distinct(F.transform(column, lambda n: n["label"]))), ",")
    starts = F.transform(base, lambda n: n["word"])
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("notices")).alias("labels"),
        F.coalesce(F.array_max(F.transform("notices", lambda n: n["coverage"])), F.lit(0.0)).alias("score"),
    )
