import math
import random
import re
from collections import Counter

import pytest

from tephra.llm import licences

from .helpers import empty, frame


PROSE = ' '.join(f'prose{i}' for i in range(60))


def model(threshold=0.6):
    return licences.Templates(licences.TEMPLATES, {b"the": 90, b"license": 5, b"under": 30, b"of": 80, b"to": 70}, 100, threshold)


@pytest.mark.parametrize("name,text", [(n, t) for n, texts in licences.TEMPLATES.items() for t in texts])
def test_templates_find_themselves(name, text):
    score, found, whole = model().scan(f"{PROSE}\n{text.upper()}\n{PROSE}".encode())
    assert found == name and score > 0.99 and not whole
    assert model().scan(text.encode())[2]


def test_clean_texts_have_none():
    assert model().scan(b"the license of the dog is to be under the tree") == (0.0, None, False)
    assert model().scan(b"") == (0.0, None, False)


def test_pruning_loses_nothing():
    g = random.Random(1)
    words = [w for texts in licences.TEMPLATES.values() for t in texts for w in t.split()] + ["dog", "house", "runs", "\n", "\n\n", "\n"]
    m = model(0.5)
    for _ in range(300):
        parts = [" ".join(g.choice(words) for _ in range(g.randint(0, 25))) for _ in range(3)]
        if g.random() < 0.5:
            parts.insert(1, g.choice(g.choice(list(licences.TEMPLATES.values()))))
        text = "\n".join(parts).encode()
        assert m.scan(text) == m.scan(text, brute=True)


def test_inheritance_takes_the_nearest_ancestor(spark):
    mit, gpl = licences.TEMPLATES["MIT"][0], licences.TEMPLATES["GPL-3.0"][0]
    rows = [
        (1, "/LICENSE", mit), (2, "/a/b/code.py", "print"), (3, "/a/LICENSE", gpl), (4, "/x/y/z/deep.c", "int"), (5, "/a/b/own.py", f"{PROSE}\n{mit}"),
        (6, None, "no path"), (7, "top.txt", "no slash"), (8, "/ab/c.txt", None), (9, "/a/b/COPYING.txt", "nothing known"),
    ]
    got = {r["doc_id"]: (r["license"], r["origin"], r["from_dir"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert got[1][:2] == ("MIT", "own") and got[3][:2] == ("GPL-3.0", "own") and got[5][:2] == ("MIT", "own")
    assert got[2] == ("GPL-3.0", "inherited", "/a") and got[4] == ("MIT", "inherited", "") and got[8] == ("MIT", "inherited", "")
    assert got[6] == (None, "none", None) and got[9] == ("GPL-3.0", "inherited", "/a")
    assert got[7] == ("MIT", "inherited", "")


def test_two_files_of_one_directory(spark):
    rows = [(1, "/d/LICENSE.a", licences.TEMPLATES["MIT"][0]), (2, "/d/LICENSE.b", licences.TEMPLATES["GPL-3.0"][0]), (3, "/d/x", "text"), (3, "/d/x", "text")]
    got = [r["license"] for r in licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect() if r["doc_id"] == 3]
    assert len(got) == 2 and len(set(got)) == 1 and got[0] in ("MIT", "GPL-3.0")


def test_awkward_rows(spark):
    docs = frame(spark).withColumnRenamed("source", "path")
    assert licences.scan(docs).count() == docs.count()
    assert licences.scan(empty(spark).withColumnRenamed("source", "path")).count() == 0


def test_planted_lines_are_found(spark):
    from tephra.llm.queries import op9_license_scan

    sf = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    planted = {i for i, t in texts.items() if any(x in t.lower() for x in ("licensed under", "released under the mit"))}
    own = {r["doc_id"] for r in op9_license_scan(spark, sf).where("origin = 'own'").collect()}
    assert own == planted


def test_a_header_among_common_words_is_found_at_every_size(spark):
    header = "Licensed under the Apache License, Version 2.0."
    common = ["alpha", "beta", "gamma", "delta"]
    for n in (200, 2000):
        rows = [(i, f"/d{i}/x", " ".join(common) + f" own{i}") for i in range(n)] + [(n + i, f"/e{i}/x", f"{' '.join(common)} {header}") for i in range(n // 100)]
        docs = spark.createDataFrame(rows, "doc_id long, path string, text string")
        got = {r["doc_id"]: r["score"] for r in licences.scan(docs).where("origin = 'own' and license = 'Apache-2.0'").collect()}
        assert set(got) == set(range(n, n + n // 100)) and min(got.values()) > 0.9


def test_words_that_do_not_travel_have_the_same_weights(spark):
    g = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, f"/{i}/x", "\n".join(" ".join(g.choices(words, [1 / (k + 1) for k in range(40)], k=g.randint(0, 6))) + (" Released under the MIT License." if g.random() < 0.3 else "") for _ in range(3))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string")
    some = [Counter(tuple(r) for r in licences.scan(docs, frequent=k).collect()) for k in (0, 10, 1000)]
    df = Counter(t for _, _, x in rows for t in set(licences.terms(x.encode())))
    brute = licences.Templates(licences.TEMPLATES, df, len(rows), 0.6)
    want = {i: brute.scan(x.encode(), brute=True)[:2] for i, _, x in rows}
    assert some[0] == some[1] == some[2]
    assert {r[0]: (r[3], r[2]) for r in some[0] if r[4] == "own"} == {i: v for i, v in want.items() if v[1]}


@pytest.mark.parametrize("name,text", [
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "licensed under the GNU General Public License, version 2."), ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"), ("LGPL-2.1", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"), ("ISC", "SPDX-License-Identifier: ISC"), (None, "SPDX-License-Identifier: EUPL-1.2"),
    (None, "licensed under the GNU General Public License, version 9."), (None, "Licensed under the Apache License, Version 1.1."), (None, "Licensed under CC BY 2.5."),
    (None, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."), ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"), ("MIT", licences.TEMPLATES["MIT"][2].replace(". ", ".\n\n")),
])
def test_names_and_versions_are_told_apart(name, text):
    assert model().scan(f"{PROSE}\n{text}\n{PROSE}".encode())[1] == name


def test_query_equals_a_tf_idf_written_out(spark):
    """Cosines of all units and all templates, with no pruning and no shared code but the templates, the marks and the rule for words."""
    from tephra.llm.queries import op9_license_scan

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: (r["text"] or "").lower() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    word = re.compile(r"[a-z0-9][a-z0-9.+\-]*[a-z0-9+]|[a-z0-9]")
    df = Counter(w for t in texts.values() for w in set(word.findall(t)))
    idf = lambda w: math.log((1 + len(texts)) / (1 + df[w])) + 1

    def vector(words):
        v = {w: n * idf(w) for w, n in Counter(words).items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        return {w: x / norm for w, x in v.items()}

    templates = [(name, vector(word.findall(t.lower()))) for name, some in licences.TEMPLATES.items() for t in some]

    def marked(name, words):
        joined = " " + " ".join(words) + " "
        return any(all(any(f" {p} " in joined for p in g.removeprefix("!").split("|")) != g.startswith("!") for g in groups) for groups in licences.MARKS[name])

    want = {}
    for i, t in texts.items():
        units = [*t.split("\n"), *re.split(r"\n\s*\n", t), t]
        for words in map(word.findall, units):
            v = vector(words)
            for name, u in templates:
                x = round(sum(a * u.get(w, 0) for w, a in v.items()), 9)
                if x >= 0.6 and marked(name, words) and (i not in want or (-x, name) < (-want[i][0], want[i][1])):
                    want[i] = x, name
    got = {r["doc_id"]: (r["score"], r["license"]) for r in op9_license_scan(spark, sf).where("origin = 'own'").collect()}
    assert set(got) == set(want) and all(got[i][1] == want[i][1] and abs(got[i][0] - want[i][0]) < 1e-6 for i in got) and got


def test_hot_folders_and_files_without_paths(spark):
    mit = licences.TEMPLATES["MIT"][0]
    rows = [(0, "/LICENSE", mit), (1, "/a/LICENSE", licences.TEMPLATES["GPL-3.0"][0])] + [(10 + i, f"/a/x{i}", "nothing") for i in range(700)] + [(1000 + i, f"/d{i}/x", "nothing") for i in range(400)] + [(None, None, None)] * 300 + [(3000, None, f"{PROSE}\n{mit}")]
    got = Counter((r["license"], r["origin"], r["from_dir"]) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, path string, text string").repartition(5)).collect())
    assert got == {("GPL-3.0", "inherited", "/a"): 700, ("MIT", "inherited", ""): 400, (None, "none", None): 300, ("MIT", "own", None): 1, ("MIT", "own", ""): 1, ("GPL-3.0", "own", "/a"): 1}


def test_ties_go_to_the_first_by_name(spark):
    two = f"{licences.TEMPLATES['MIT'][0]}\n{licences.TEMPLATES['ISC'][0]}\n{licences.TEMPLATES['Apache-2.0'][0]}"
    docs = spark.createDataFrame([(1, "/x/a", two), (2, "/x/b", "\n".join(reversed(two.split("\n"))))], "doc_id long, path string, text string")
    assert {r["license"] for r in licences.scan(docs).collect()} == {"Apache-2.0"}
