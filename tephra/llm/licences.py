"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor directory.

A unit is a line, a paragraph or the whole text. Its vector has tf * idf for every word, with document frequencies counted over all files, so that a unit's
cosine doesn't fall with their number; a unit matches the template of largest cosine, of those whose name and version (`MARKS`) it holds, if that reaches `threshold`. A file's own finding is the best of its units; a licence
file (by its name, or matching as a whole) also speaks for its directory. A file without a finding of its own takes that of the nearest
ancestor directory that has one; ancestors meet directories in a join by path.

Exact candidate rules: a unit without a word of the marks can't match a template that has some; one whose shared terms avoid a template's heaviest terms (all but a rest of norm below the threshold) can't reach the threshold; nor can
one that falls short of it when its rarer words get the least weight they may have. The frequencies of the templates' terms and of the most frequent words
travel with the code; the other words of the units that are left meet theirs in a join by word.

Rules for odd input: a null text is empty and has no finding of its own but may inherit; a null path inherits nothing; ties between templates and units go to the
first by name; repeated rows are scanned each; an empty table gives an empty result. Texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, hot_keys, join_hot

FREQUENT = 20_000
TERM = re.compile(rb"[a-z0-9][a-z0-9.+\-]*[a-z0-9+]|[a-z0-9]")
#: Headers, titles and the paragraphs that tell a licence, by SPDX name (one longer than that would match whole files that only hold it). `MARKS` has the names and versions that a unit must hold.
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_GNU_TITLE = "GNU {0} Version {1}, {2} Copyright (C) {3} Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_NO_WARRANTY = " without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. See the GNU {0} for more details."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_TWO = ": 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_THIRD = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."


def _gnu(name: str, version: str, date: str, years: str) -> list[str]:
    return [f"This work is licensed under the GNU {name}, version {version}.", _GNU.format(name, version), _GNU.format(name, version) + " This program is distributed in the hope that it will be useful, but" + _NO_WARRANTY.format(name), _GNU_TITLE.format(name.upper(), version, date, years)]


def _cc(name: str, short: str, version: str) -> list[str]:
    return [f"Licensed under CC {short} {version}.", f"This work is licensed under a Creative Commons {name} {version} International License."]


TEMPLATES = {
    "AGPL-3.0": ["This program is licensed under the GNU Affero General Public License, version 3.", *_gnu("Affero General Public License", "3", "19 November 2007", "2007")],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", _BSD + _BSD_TWO],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", _BSD + _BSD_THIRD, _BSD_THIRD],
    "CC-BY-3.0": ["Licensed under CC BY 3.0.", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."],
    "CC-BY-4.0": _cc("Attribution", "BY", "4.0"),
    "CC-BY-NC-4.0": _cc("Attribution-NonCommercial", "BY-NC", "4.0"),
    "CC-BY-NC-ND-4.0": _cc("Attribution-NonCommercial-NoDerivatives", "BY-NC-ND", "4.0"),
    "CC-BY-NC-SA-4.0": _cc("Attribution-NonCommercial-ShareAlike", "BY-NC-SA", "4.0"),
    "CC-BY-ND-4.0": _cc("Attribution-NoDerivatives", "BY-ND", "4.0"),
    "CC-BY-SA-3.0": ["Licensed under CC BY-SA 3.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."],
    "CC-BY-SA-4.0": _cc("Attribution-ShareAlike", "BY-SA", "4.0"),
    "CC0-1.0": ["Licensed under CC0 1.0.", "Creative Commons Legal Code CC0 1.0 Universal", "This work is dedicated to the public domain under CC0 1.0 Universal (Creative Commons Zero)."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0", "Licensed under the Eclipse Public License, version 2.0."],
    "GPL-2.0": _gnu("General Public License", "2", "June 1991", "1989, 1991"),
    "GPL-3.0": _gnu("General Public License", "3", "29 June 2007", "2007"),
    "ISC": ["Released under the ISC License.", _ISC],
    "LGPL-2.0": _gnu("Library General Public License", "2", "June 1991", "1991"),
    "LGPL-2.1": _gnu("Lesser General Public License", "2.1", "February 1999", "1991, 1999"),
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3.", *_gnu("Lesser General Public License", "3", "29 June 2007", "2007")],
    "MIT": ["Released under the MIT License.", _MIT + ", to deal in the Software without restriction", _MIT + " (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Mozilla Public License Version 2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": ["Released under the zlib License.", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"],
}
_TWO, _THREE = "version 2|version 2.0|v2|v2.0|v. 2", "version 3|version 3.0|v3|v3.0|v. 3"
#: For each licence alternatives, each of groups of phrases: a unit that matches has a phrase of every group of one alternative, and none of a group with !.
MARKS = {
    "AGPL-3.0": [["affero general public license|gnu agpl", _THREE], ["agplv3"]],
    "Apache-2.0": [["apache license|apache software license", _TWO + "|license 2.0"]],
    "BSD-2-Clause": [["bsd 2-clause|bsd-2-clause|2-clause bsd|simplified bsd"], ["redistribution and use in source and binary forms", "redistributions in binary form must reproduce", "!neither the name|endorse or promote products"]],
    "BSD-3-Clause": [["bsd 3-clause|bsd-3-clause|3-clause bsd|new bsd"], ["neither the name", "endorse or promote products"]],
    "CC0-1.0": [["cc0 1.0|cc0-1.0|creative commons zero"]],
    "EPL-2.0": [["eclipse public license", _TWO + "|license 2.0"]],
    "GPL-2.0": [["gnu general public license|gnu gpl", _TWO], ["gplv2"]],
    "GPL-3.0": [["gnu general public license|gnu gpl", _THREE], ["gplv3"]],
    "ISC": [["isc license|isc licence"], ["permission to use copy modify and or distribute this software for any purpose|permission to use copy modify and distribute this software for any purpose"]],
    "LGPL-2.0": [["gnu library general public license", _TWO]],
    "LGPL-2.1": [["gnu lesser general public license|gnu lgpl", "version 2.1|v2.1|v. 2.1"], ["lgplv2.1"]],
    "LGPL-3.0": [["gnu lesser general public license|gnu lgpl", _THREE], ["lgplv3"]],
    "MIT": [["mit license|mit licence"], ["permission is hereby granted free of charge to any person obtaining a copy"]],
    "MPL-2.0": [["mozilla public license", _TWO + "|v 2.0|license 2.0"]],
    "Unlicense": [["free and unencumbered software"]],
    "Zlib": [["zlib license"], ["to alter it and redistribute it freely"]],
}
for _long, _short, _versions in (("attribution", "by", ("3.0", "4.0")), ("attribution-noncommercial", "by-nc", ("4.0",)), ("attribution-noncommercial-noderivatives", "by-nc-nd", ("4.0",)), ("attribution-noncommercial-sharealike", "by-nc-sa", ("4.0",)), ("attribution-noderivatives", "by-nd", ("4.0",)), ("attribution-sharealike", "by-sa", ("3.0", "4.0"))):
    for _v in _versions:
        MARKS[f"CC-{_short.upper()}-{_v}"] = [[f"cc {_short} {_v}|cc-{_short}-{_v}|cc-{_short} {_v}|commons {_long} {_v}"]]
for _name in TEMPLATES:
    _ids = [_name, *((f"{_name}-only", f"{_name}-or-later", f"{_name}+") if "GPL" in _name else ())]
    TEMPLATES[_name] = [*TEMPLATES[_name], *(f"SPDX-License-Identifier: {x}" for x in _ids)]
    MARKS[_name] = [*MARKS[_name], ["|".join(f"spdx-license-identifier {x.lower()}" for x in _ids)]]
LICENCE_NAME = re.compile(r"(^|/)(un)?licen[cs]e[^/]*$|(^|/)(copying|notice|copyright)[^/]*$", re.I)


def terms(raw: bytes) -> list[bytes]:
    return TERM.findall(raw.lower())


class Templates:
    """Template vectors for given document frequencies. A word that `df` doesn't hold is in at most `most` files."""

    def __init__(self, templates: dict[str, list[str]], df: dict[bytes, int], files: int, threshold: float, most: int = 0):
        self.rows = [(name, Counter(terms(t.encode()))) for name, texts in sorted(templates.items()) for t in texts]
        self.other = math.log((1 + files) / (1 + most)) + 1
        vocabulary = sorted({t for _, c in self.rows for t in c})
        self.idf = {t: math.log((1 + files) / (1 + n)) + 1 for t, n in {**dict.fromkeys(vocabulary, 0), **df}.items()}
        self.threshold = threshold
        self.by_term, self.need = {}, set()
        self.marks = {name: [[(not group.startswith("!"), [f" {p} ".encode() for p in group.removeprefix("!").split("|")]) for group in groups] for groups in MARKS[name]] for name in templates if name in MARKS}
        for groups in (g for found in self.marks.values() for g in found):
            self.need.update(max(p.split(), key=len) for p in groups[0][1])  # a unit with a phrase of the first group has that word
        for i, (name, c) in enumerate(self.rows):
            w = {t: n * self.idf[t] for t, n in c.items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            w = {t: x / norm for t, x in w.items()}
            rest = 0.0
            for t in sorted(w, key=lambda t: (w[t], t)):
                self.by_term.setdefault(t, []).append((i, w[t]))
                rest += w[t] ** 2
                if rest >= threshold**2 and name not in self.marks:  # the lighter terms alone fall short
                    self.need.add(t)

    def weigh(self, unit: list[bytes]) -> tuple[float, str, float, dict[bytes, int]] | None:
        """(product with the nearest template, its name, squared norm of the words with known frequencies, number of each other word) of a unit that may match."""
        own, dots, rest = 0.0, {}, {}
        for t, n in Counter(unit).items():
            idf = self.idf.get(t)
            if idf is None:
                rest[t] = n
                continue
            w = n * idf
            own += w * w
            for i, x in self.by_term.get(t, ()):
                dots[i] = dots.get(i, 0.0) + w * x
        norm = math.sqrt(own + sum((n * self.other) ** 2 for n in rest.values()))
        near = sorted((-round(x, 12), i) for i, x in dots.items() if round(x / norm, 9) >= self.threshold)
        joined = b" " + b" ".join(unit) + b" " if near else b""
        for _, i in near:
            name = self.rows[i][0]
            if name not in self.marks or any(all(any(p in joined for p in group) == wanted for wanted, group in groups) for groups in self.marks[name]):
                return dots[i], name, own, rest
        return None

    def units(self, raw: bytes, brute: bool = False) -> list[tuple[float, str, float, dict[bytes, int], bool]]:
        """What `weigh` tells of each unit that may match, and whether the unit is the whole text."""
        low = raw.lower()
        every = TERM.findall(low)
        if not brute and self.need.isdisjoint(every):
            return []
        parts = [terms(x) for x in low.split(b"\n")]
        if len(parts) > 2:
            parts += [terms(x) for x in re.split(rb"\n\s*\n", low) if b"\n" in x or brute]
        found = [(self.weigh(x), False) for x in parts if brute or not self.need.isdisjoint(x)]
        return [(*x, whole) for x, whole in [*found, (self.weigh(every), True)] if x]

    def scan(self, raw: bytes, brute: bool = False) -> tuple[float, str | None, bool]:
        """(cosine, licence, whether the text as a whole matched) of the best unit, or (0, None, False); words that aren't known weigh as `most` files give."""
        ranked = [(round(dot / math.sqrt(own + sum((n * self.other) ** 2 for n in rest.values())), 9), name, whole) for dot, name, own, rest, whole in self.units(raw, brute)]
        if not ranked:
            return (0.0, None, False)
        score, name, _ = min(ranked, key=lambda x: (-x[0], x[1]))
        return score, name, any(whole for _, _, whole in ranked)


def frequencies(files: DataFrame, text: str = "text") -> DataFrame:
    """(term, n): the number of files that hold each word; the empty term has the number of all files."""

    def count(batches):
        total = Counter()
        for batch in batches:
            for raw in as_bytes(batch.column(0)).to_pylist():
                total.update({b"", *terms(raw or b"")})
            if len(total) > 400_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], ["term", "n"])
                total = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

    return cut(files.select(F.col(text).alias("text")).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n")))


def fitted(counts: DataFrame, templates: dict[str, list[str]], threshold: float, frequent: int = FREQUENT) -> tuple[Templates, int]:
    """The templates with the frequencies of their own terms and of at most `frequent` of the most frequent words; the number of files."""
    classes = {r["k"]: r["n"] for r in counts.where("term != ''").groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()}  # a row for each power of two
    k, room = max(classes, default=-1) + 1, frequent
    while k > 0 and classes.get(k - 1, 0) <= room:
        k -= 1
        room -= classes.get(k, 0)
    vocabulary = sorted({"", *(t.decode() for texts in templates.values() for x in texts for t in terms(x.encode()))})
    df = {r["term"].encode(): r["n"] for r in counts.where((F.col("n") >= 2**k) | F.col("term").isin(vocabulary)).collect()}  # at most `frequent`, and the templates' terms
    files = df.pop(b"", 0)
    return Templates(templates, df, files, threshold, 2**k - 1), files


def scan(files: DataFrame, path: str = "path", text: str = "text", key: str = "doc_id", templates: dict[str, list[str]] | None = None, threshold: float = 0.6, frequent: int = FREQUENT) -> DataFrame:
    """A row for each file: key, path, license, score, origin (own, inherited or none), from_dir (the directory that gave it)."""
    counts = frequencies(files, text)
    model, n_files = fitted(counts, TEMPLATES if templates is None else templates, threshold, frequent)
    shipped = files.sparkSession.sparkContext.broadcast(model)
    unit = pa.struct([("dot", pa.float64()), ("name", pa.string()), ("own", pa.float64()), ("rest", pa.list_(pa.struct([("term", pa.string()), ("k", pa.int64())]))), ("whole", pa.bool_())])

    def run(batches):
        model, at = shipped.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            found = []
            for raw in as_bytes(batch.column(2)).to_pylist():
                found.append([{"dot": dot, "name": name, "own": own, "rest": [{"term": t.decode(), "k": n} for t, n in rest.items()], "whole": whole} for dot, name, own, rest, whole in model.units(raw or b"")])
            named = [bool(p and LICENCE_NAME.search(p)) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(range(at, at + len(found)), pa.int64()), pa.array(named, pa.bool_()), pa.array(found, pa.list_(unit))], ["doc_id", "path", "row", "named", "units"])
            at += len(found)

    schema = "doc_id long, path string, row long, named boolean, units array<struct<dot: double, name: string, own: double, rest: array<struct<term: string, k: long>>, whole: boolean>>"
    read = cut(files.select(F.col(key).cast("long").alias("doc_id"), F.col(path).alias("path"), F.col(text).alias("text")).mapInArrow(run, schema))
    units = read.select("row", F.posexplode("units").alias("at", "u")).select("row", "at", "u.*")
    # words that didn't travel meet their frequencies by word: each is in fewer than 2^k files, so no key is large
    words = units.select("row", "at", F.explode("rest").alias("w")).select("row", "at", "w.*").join(counts, "term")
    norms = words.groupBy("row", "at").agg(F.sum(F.pow(F.col("k") * (F.log((1 + F.lit(n_files)) / (1 + F.col("n"))) + 1), F.lit(2))).alias("others"))
    scored = units.drop("rest").join(norms, ["row", "at"], "left").withColumn("score", F.round(F.col("dot") / F.sqrt(F.col("own") + F.coalesce("others", F.lit(0.0))), 9)).where(F.col("score") >= threshold)
    best = scored.groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("name"))).alias("v"), F.max("whole").alias("whole"))
    license = F.col("v.name")
    speaks = license.isNotNull() & (F.coalesce("whole", F.lit(False)) | F.col("named"))
    return inherit(cut(read.drop("units").join(best, "row", "left").select("doc_id", "path", license.alias("license"), F.coalesce(-F.col("v.s"), F.lit(0.0)).alias("score"), speaks.alias("speaks"))))


def inherit(found: DataFrame) -> DataFrame:
    """Adds origin and from_dir to (doc_id, path, license, score, speaks); one directory's licence files are settled by score, then name.

    A directory may hold a large part of the files, and be above a large part of the directories: its rows are then dealt to several tasks."""
    folder = F.regexp_replace(F.col("path"), "/?[^/]*$", "")
    voices = (
        found.where("speaks and path is not null")
        .groupBy(folder.alias("dir"))
        .agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("license").alias("name"))).alias("v"))
        .select("dir", F.col("v.name").alias("given"), (-F.col("v.s")).alias("given_score"))
    )
    bare = cut(found.where("license is null and path is not null").groupBy(folder.alias("folder")).agg(F.count("*").alias("n")))
    folders, files = bare.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    parts = F.split("folder", "/")
    above = bare.select("folder", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, 1, i), "/").alias("dir")))).alias("a")).select("folder", "a.depth", "a.dir")
    high = hot_keys(above.groupBy("dir").agg(F.count("*").alias("n")), "dir", folders)
    nearest = join_hot(above, voices.hint("merge"), "dir", high, F.xxhash64("folder")).groupBy("folder").agg(F.max_by(F.struct("dir", "given", "given_score"), "depth").alias("near"))
    # files with a finding of their own, or without a path, ask for no directory; a key for each keeps them apart
    asks = found.withColumn("folder", F.when(F.col("license").isNull() & F.col("path").isNotNull(), folder).otherwise(F.concat_ws(":", F.lit("none"), "doc_id", F.spark_partition_id())))
    out = join_hot(asks, nearest.hint("merge"), "folder", hot_keys(bare, "folder", files), F.xxhash64("doc_id", F.spark_partition_id()), "left")
    own = F.col("license").isNotNull()
    return out.select(
        "doc_id",
        "path",
        F.when(own, F.col("license")).otherwise(F.col("near.given")).alias("license"),
        F.when(own, F.col("score")).otherwise(F.coalesce(F.col("near.given_score"), F.lit(0.0))).alias("score"),
        F.when(own, "own").when(F.col("near.given").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(own, folder).otherwise(F.col("near.dir")).alias("from_dir"),
    )
