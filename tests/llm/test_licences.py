import math
import os
import re
import textwrap
from collections import Counter

import pytest
from reckoner.llm import licences as L

APACHE, MIT, GPL = (L.TEMPLATES[x] for x in ("Apache-2.0", "MIT", "GPL-3.0"))
PROSE = "This library of the public work is here, and the terms of use are under review in the version that follows.\n" * 3


def plain_best(text):
    """The licence, its cosine and whether it is most of the text: every window against every template, with dictionaries."""
    split = lambda x: re.findall(rb"[a-z0-9]+(?:[.-][a-z0-9]+)*", x.lower())
    templates = {name: split(t.encode()) for name, t in L.TEMPLATES.items()}
    seen = Counter(w for t in templates.values() for w in set(t))
    idf = lambda w: math.log((1 + len(templates)) / (1 + seen.get(w, 0))) + 1
    vector = lambda words: {w: n * idf(w) for w, n in Counter(words).items()}
    words, found = split(text), None
    for name, template in templates.items():
        t, size = vector(template), min(len(template), len(words))
        for i in range(len(words) - size + 1 if words else 0):
            v = vector(words[i : i + size])
            cosine = sum(x * t.get(w, 0) for w, x in v.items()) / math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in t.values()))
            if cosine >= 0.8:
                licence = name.split("#")[0]
                key = (licence == "Proprietary", -round(min(1.0, cosine), 9), licence, -len(template))
                found = min(found, key) if found else key
    return (found[2], -found[1], -2 * found[3] >= len(words)) if found else (None, None, False)


def brute(rows, any_statement):
    own = [(i, p, *(plain_best((t or "").encode()) if len(t or "") < 5000 else ("MIT", 1.0, False))) for i, p, t in rows]
    granted = {}
    for _, path, licence, cosine, mostly in own:
        if path and licence and (any_statement or mostly or path.split("/")[-1].lower().split(".")[0] in ("license", "licence", "copying", "notice")):
            folder = path.rpartition("/")[0]
            granted[folder] = min(granted.get(folder, (1, "")), (-cosine, licence))
    out = []
    for i, path, licence, cosine, _ in own:
        source = None
        if licence is None and path is not None:
            folder = path.rpartition("/")[0]
            while True:
                if folder in granted:
                    licence, source = granted[folder][1], folder
                    break
                if not folder:
                    break
                folder = folder.rpartition("/")[0]
        out.append((i, path, licence, None if cosine is None else round(cosine, 9), source))
    return sorted(out, key=repr)


def test_matches_brute_force(spark):
    rows = [
        (1, "a/LICENSE", MIT), (2, "a/b/c/file.py", PROSE), (3, "a/b/LICENSE.txt", f"{APACHE}\n"), (4, "a/b/x.py", f"{GPL}\n{PROSE}"), (5, "a/other.py", None),
        (6, "z/one.py", PROSE), (7, "LICENSE", "All rights reserved.\nUnauthorised copying is prohibited."), (8, None, MIT), (9, None, PROSE), (10, "top.py", ""), (11, "a/b/c/file.py", PROSE), (12, "q/r/s", "w " * 100_000 + "\n" + MIT),
        (13, "q/r/t", PROSE), (14, "m/licensed under the", "Licensed under CC BY-NC 4.0."), (15, "m/n", "licensed under cc by 4.0"),
    ]
    files = spark.createDataFrame([(i, p, t, "x") for i, p, t in rows], "file_id long, path string, text string, licence string")
    for any_statement in (False, True):
        found = L.scan(files).select("file_id", "path", "found.licence", "found.cosine", "found.mostly")
        got = [(r[0], r[1], r[2], None if r[3] is None else round(r[3], 9), r[4]) for r in L.inherit(found, any_statement).collect()]
        assert sorted(got, key=repr) == brute(rows, any_statement)
    assert {r.licence for r in L.scan(files).select("found.licence").collect()} >= {"MIT", "Apache-2.0", "GPL-3.0", "CC-BY-NC-4.0", "CC-BY-4.0", "Proprietary"}
    assert L.inherit(found.limit(0)).collect() == []


def test_planted_statements(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    want = {d.doc_id for d in docs if "icensed under" in d.text or "under the MIT License" in d.text}
    got = {r.doc_id for r in L.op4_license_scan(spark, "/root/testdata/sf0.01").filter("cosine IS NOT NULL").collect()}
    assert len(got & want) >= 0.95 * len(want)


def test_every_planted_form_is_found(spark):
    """Lines of the corpus that state a licence, by form; each document has the licence of one of its lines."""
    forms = {
        "All rights reserved.": "Proprietary",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "Released under the MIT License.": "MIT",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    }
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    stated = {}
    for d in docs.filter(docs.text.rlike("(?i)licensed under|MIT License|rights reserved")).collect():
        if here := {forms[line] for line in d.text.splitlines() if line in forms}:
            stated[d.doc_id] = here
    assert set().union(*stated.values()) == set(forms.values())
    got = {r.doc_id: r.licence for r in L.op4_license_scan(spark, "/root/testdata/sf0.1").filter("cosine IS NOT NULL").collect()}
    assert all(got.get(i) in here for i, here in stated.items())


def test_reserved_rights_yield_to_a_licence():
    matcher = L.Matcher(L.TEMPLATES)
    assert matcher.best(b"All rights reserved.\nmore words\n" + MIT.encode())[0] == "MIT"
    assert all(matcher.best(x.encode())[0] == "Proprietary" for x in ("All rights reserved.", "all rights are reserved", "Tous droits réservés.", L.TEMPLATES["Proprietary"]))


@pytest.mark.parametrize("name", ["MIT#text", "BSD-3-Clause#text", "BSD-2-Clause#text", "Apache-2.0#notice", "Apache-2.0#head", "GPL-3.0#head", "GPL-3.0#notice", "GPL-2.0#notice", "LGPL-2.1#notice", "AGPL-3.0#notice", "MPL-2.0#notice", "ISC#text"])
def test_texts_and_headers(name):
    """A licence as a file of its own, wrapped and under a copyright line; as a commented header; in the middle of prose."""
    matcher = L.Matcher(L.TEMPLATES)
    text, want = L.TEMPLATES[name], name.split("#")[0]
    alone = f"Copyright (c) 2020 Some Holder\n\n{textwrap.fill(text, 60)}\n"
    licence, cosine, mostly = matcher.best(alone.encode())
    assert (licence, mostly) == (want, True) and cosine > 0.9
    header = "\n".join(f"# {line}" for line in textwrap.wrap(text, 40)) + "\n" + PROSE * 20
    assert matcher.best(header.encode())[0] == want
    assert matcher.best(f"{PROSE} and so {text} and so on {PROSE}".encode())[0] == want


def test_files_of_licence_texts(spark):
    """Whole licence texts, where this machine has them, named as licence files."""
    texts = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "GPL-2": "GPL-2.0", "MPL-2.0": "MPL-2.0", "LGPL-3": "LGPL-3.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0"}
    here = {want: f"/usr/share/common-licenses/{file}" for file, want in texts.items() if os.path.isfile(f"/usr/share/common-licenses/{file}")}
    rows = [(i, f"{want}/LICENSE", open(path, encoding="utf-8").read()) for i, (want, path) in enumerate(here.items())]
    rows += [(i + 100, f"{want}/src/x.py", "code") for i, want in enumerate(here)]
    if not here:
        pytest.skip("no licence texts here")
    found = L.scan(spark.createDataFrame(rows, "file_id long, path string, text string")).select("file_id", "path", "found.licence", "found.cosine", "found.mostly")
    for r in L.inherit(found).collect():
        assert r.licence == r.path.split("/")[0]


def test_plain_best_on_the_table(spark):
    matcher = L.Matcher(L.TEMPLATES)
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) < 900 and text rlike '(?i)licens|rights|MIT'").limit(12).collect()
    texts = [r.text for r in rows] + ["license " * 300, "the software the software " * 40, "spdx-license-identifier: MIT", "SPDX-License-Identifier: GPL-2.0-or-later"]
    for text in texts:
        licence, cosine, mostly = plain_best(text.encode())
        got = matcher.best(text.encode())
        assert (got[0], got[2]) == (licence, mostly) and (cosine is None or abs(cosine - got[1]) < 1e-6)
