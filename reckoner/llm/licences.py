"""License scans: licence texts, headers and statements by TF-IDF cosine, then the nearest licensed directory.

A text is the sequence of its words, whatever its lines. For each template, every
window of as many words as the template has is a sparse TF-IDF vector and compared
with it (a shorter text is one window); the file's licence is the template with the
largest cosine, if MATCH or more. So a header is found inside a longer file, and a
statement inside a line of prose or wrapped over several. Templates are whole
licence texts, or, of the long ones, the head of the text; the notices to put into
files; tags and one-line statements. Inverse document frequencies come from the
templates; words outside them weigh as much as the rarest and count into a window's
length, so that prose with a few licence words stays far from every template.

A file of which the window found is half or more is a licence file of its
directory; so is one named like LICENSE or COPYING that has a licence. A file
without a statement inherits from the nearest directory above it that holds a
licence file or, with `any_statement`, any file with a statement: paths are taken
apart into their ancestors and joined with the licensed directories, and the
longest wins.

Several templates may state one licence: their names are the licence and, after
a `#`, the wording. Rights that are only reserved are often the notice above a
licence, so the licence counts where a text holds both.

Defined cases: null or empty text has no statement; a null path gets no
inheritance; of a directory's statements the one with the largest cosine counts,
equals by template name; repeated rows each get their row; other columns are
ignored; no rows give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import cut, table, utf8

MATCH = 0.8
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
_MIT_END = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_APACHE_HEAD = """Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"""
_GPL = """This {0} is free software{1} you can redistribute it and/or modify it under the terms of the GNU {2}General Public License as published by the Free Software Foundation{3} either version {4} of the License, or (at your option) any later version. This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {2}General Public License for more details."""
_GPL_HEAD = """GNU {0}GENERAL PUBLIC LICENSE Version {1} Copyright (C) {2} Free Software Foundation, Inc. {3} Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."""
_FRANKLIN = "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""
#: Public licences: texts, notices and statements. Fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0#head": _APACHE_HEAD,
    "Apache-2.0#notice": _APACHE,
    "BSD-2-Clause#text": f"{_BSD} {_BSD_END}",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "BSD-3-Clause#notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-3-Clause#text": f"{_BSD} {_BSD_3} {_BSD_END}",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-4.0#notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0#notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0#notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0.",
    "CC0-1.0#head": "Creative Commons Legal Code CC0 1.0 Universal",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0#head": _GPL_HEAD.format("", "2, June 1991", "1989, 1991", _FRANKLIN),
    "GPL-2.0#notice": _GPL.format("program", ";", "", ";", "2"),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0#head": _GPL_HEAD.format("", "3, 29 June 2007", "2007", "<https://fsf.org/>"),
    "GPL-3.0#notice": _GPL.format("program", ":", "", ",", "3"),
    "AGPL-3.0#head": _GPL_HEAD.format("AFFERO ", "3, 19 November 2007", "2007", "<https://fsf.org/>"),
    "AGPL-3.0#notice": _GPL.format("program", ":", "Affero ", ",", "3"),
    "ISC#text": f"{_ISC} {_MIT_END.split(', ARISING')[0]}",
    "ISC#head": _ISC,
    "LGPL-2.1#head": _GPL_HEAD.format("LESSER ", "2.1, February 1999", "1991, 1999", _FRANKLIN),
    "LGPL-2.1#notice": _GPL.format("library", ";", "Lesser ", ";", "2.1"),
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0#head": _GPL_HEAD.format("LESSER ", "3, 29 June 2007", "2007", "<https://fsf.org/>"),
    "MIT": "Released under the MIT License.",
    "MIT#text": f"{_MIT} {_MIT_END}",
    "MIT#grant": _MIT,
    "MIT#title": "The MIT License (MIT)",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0#head": "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software.",
    "MPL-2.0#notice": _MPL,
    "Proprietary": "All rights reserved. Unauthorised copying is prohibited.",
    "Proprietary#notice": "All rights reserved.",
    "Proprietary#are": "All rights are reserved.",
    "Proprietary#de": "Alle Rechte vorbehalten.",
    "Proprietary#es": "Todos los derechos reservados.",
    "Proprietary#fr": "Tous droits réservés.",
    "Unlicense#text": _UNLICENSE,
} | {
    f"{name}#spdx-{tag}": f"SPDX-License-Identifier: {tag}"
    for name, tags in {
        "Apache-2.0": ["Apache-2.0"], "BSD-2-Clause": ["BSD-2-Clause"], "BSD-3-Clause": ["BSD-3-Clause"], "CC0-1.0": ["CC0-1.0"], "ISC": ["ISC"], "MIT": ["MIT"], "MPL-2.0": ["MPL-2.0"], "Unlicense": ["Unlicense"],
        "GPL-2.0": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later"], "GPL-3.0": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"], "LGPL-3.0": ["LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"],
        "LGPL-2.1": ["LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later"], "AGPL-3.0": ["AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"],
    }.items()
    for tag in tags
}
RESERVED = "Proprietary"
LICENCE_NAMES = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"
FOUND = T.StructType([T.StructField("licence", T.StringType()), T.StructField("cosine", T.DoubleType()), T.StructField("mostly", T.BooleanType())])
_WORD = re.compile(rb"[a-z0-9]+(?:[.-][a-z0-9]+)*")


class Matcher:
    def __init__(self, templates: dict[str, str]):
        words = {name: Counter(_WORD.findall(text.lower().encode())) for name, text in sorted(templates.items())}
        seen = Counter(w for c in words.values() for w in c)
        self.number = {w: i for i, w in enumerate(seen)}  # words outside have the last place
        self.idf = np.array([*(math.log((1 + len(templates)) / (1 + n)) + 1 for n in seen.values()), math.log(1 + len(templates)) + 1])
        self.templates: list[tuple[str, int, np.ndarray]] = []  # name, words, what a word adds to the product with it
        for name, counts in words.items():
            weights = np.zeros(len(self.idf))
            for w, n in counts.items():
                weights[self.number[w]] = n * self.idf[self.number[w]]
            self.templates.append((name, counts.total(), weights / math.sqrt((weights**2).sum()) * self.idf))
        squares = np.array([(weights / self.idf) ** 2 for _, _, weights in self.templates])[:, :-1]
        self.squares = squares / squares.sum(axis=1, keepdims=True)

    def _cosine(self, words: np.ndarray, size: int, weights: np.ndarray) -> float:
        """The largest cosine of a window of `size` of the words; 0 where it is under MATCH."""
        size = min(size, len(words))
        products = np.concatenate([[0.0], np.cumsum(weights[words])])
        squares = np.concatenate([[0.0], np.cumsum(self.idf[words] ** 2)])
        # A word that comes n times weighs n squared in a window's length, so this length is too short, or right.
        product = products[size:] - products[:-size]
        likely = np.flatnonzero(product >= (MATCH - 1e-9) * np.sqrt(squares[size:] - squares[:-size]))
        if not len(likely):
            return 0.0
        first = int(likely[0])
        held: dict[int, int] = Counter(words[first : first + size].tolist())
        square = sum((n * self.idf[w]) ** 2 for w, n in held.items())
        best, at = 0.0, first
        likely = set(likely.tolist())
        idf2, listed, last = (self.idf**2).tolist(), words.tolist(), max(likely)
        while True:
            if at in likely:
                best = max(best, float(product[at]) / math.sqrt(square))
            if at == last:
                return best if best >= MATCH else 0.0
            gone, new = listed[at], listed[at + size]
            square -= (2 * held[gone] - 1) * idf2[gone]
            held[gone] -= 1
            n = held.get(new, 0)
            square += (2 * n + 1) * idf2[new]
            held[new] = n + 1
            at += 1

    def best(self, text: bytes) -> tuple[str | None, float | None, bool]:
        outside = len(self.number)
        words = np.array([self.number.get(w, outside) for w in _WORD.findall(text.lower())], np.int64)
        if not len(words):
            return None, None, False
        held = np.bincount(words, minlength=outside + 1)[:-1] > 0
        # No window is nearer to a template than the template's own words that the text has.
        possible = np.flatnonzero(self.squares @ held >= (MATCH - 1e-9) ** 2)
        found: tuple | None = None
        for name, size, weights in (self.templates[i] for i in possible):
            cosine = min(1.0, self._cosine(words, size, weights))
            if cosine:
                name = name.partition("#")[0]
                key = (name == RESERVED, -round(cosine, 12), name, -size)
                found = min(found, key) if found else key
        if not found:
            return None, None, False
        return found[2], -found[1], -2 * found[3] >= len(words)


def scan(files: DataFrame, text_col: str = "text", out_col: str = "found", templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """files with a struct of licence, cosine and whether the statement is most of the text."""
    shared = files.sparkSession.sparkContext.broadcast(templates)

    @arrow_udf(FOUND)
    def match(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(shared.value)
        for texts in batches:
            rows = [matcher.best(t) for t in texts.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.bool_())], names=["licence", "cosine", "mostly"])

    return files.withColumn(out_col, match(utf8(F.col(text_col))))


def _parent(path) -> F.Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def inherit(found: DataFrame, any_statement: bool = False) -> DataFrame:
    """file_id, path, licence, cosine, inherited_from for rows of file_id, path, licence, cosine, mostly."""
    named = F.element_at(F.split("path", "/"), -1).rlike(LICENCE_NAMES)
    speaks = F.lit(True) if any_statement else F.col("mostly") | named
    stated = found.filter(F.col("licence").isNotNull() & F.col("path").isNotNull() & speaks)
    best = F.min(F.struct((-F.col("cosine")).alias("far"), F.col("licence").alias("licence"))).alias("best")
    directories = stated.groupBy(_parent(F.col("path")).alias("directory")).agg(best).select("directory", F.col("best.licence").alias("granted"))
    open_ = found.filter("licence IS NULL AND path IS NOT NULL").select(_parent(F.col("path")).alias("home")).distinct()
    parts = F.split("home", "/")
    above = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    reached = open_.select("home", F.explode(above).alias("directory")).join(directories, "directory")
    nearest = reached.groupBy("home").agg(F.max_by(F.struct("directory", "granted"), F.length("directory")).alias("near"))
    joined = found.withColumn("home", F.when(F.col("licence").isNull(), _parent(F.col("path")))).join(nearest, "home", "left")
    return joined.select("file_id", "path", F.coalesce("licence", "near.granted").alias("licence"), "cosine", F.col("near.directory").alias("inherited_from"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree: source, then language, then folders of fifty. Any file with a statement speaks for its folder."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.floor(F.col("doc_id") / 50).cast("string"), F.col("doc_id").cast("string"))
    found = scan(docs.select(F.col("doc_id").alias("file_id"), path.alias("path"), "text"))
    rows = cut(found.select("file_id", "path", "found.licence", "found.cosine", "found.mostly"))
    return inherit(rows, any_statement=True).withColumnRenamed("file_id", "doc_id")
