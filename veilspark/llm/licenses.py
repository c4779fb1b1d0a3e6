"""License scans in DataFrame operations only: MinHash bands retrieve templates, exact containment verifies them.

Texts and templates are words of letters and digits, A-Z lowered, hashed in shingles of five. Windows of consecutive
shingles begin at every shingle, so they overlap; a band is a hash of ROWS MinHashes of a window. A template offers every
window of its own, of a length that follows from its size (WIDTHS), and is retrieved where a band of the text meets one of
its bands. Two windows of Jaccard similarity J meet in one of the BANDS bands with probability 1 - (1 - J^2)^2: an unchanged
stretch of the template as long as a window meets for certain, one with a shingle exchanged in a window of eight (J = 7/9)
with 0.84. A text that holds 0.8 of a template's shingles holds unchanged windows unless they stand apart singly.

Bands of the templates are a list of constants that every text is tested against. Only texts that meet one are exploded to
their bands, which a broadcast table maps to templates; each retrieved template is joined to its shingles, and the share
of them that the whole text holds is computed exactly. THRESHOLD or more is a match. The catalogue is all that is
broadcast; retrieved texts (row, template, shingles) are shuffled once to count each template once.

Defined results. Null, empty or short text matches nothing. Rows may repeat; each gives its own matches, also with a null
doc_id. Further columns are ignored. An empty table or catalogue gives an empty result.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.shared import lower_ascii, whole_text

SHINGLE, THRESHOLD = 5, 0.8
#: Windows of so many shingles for templates of at least so many. Each is a power of two, made of two of the one before.
WIDTHS = ((1, 1), (4, 4), (8, 16))
BANDS, ROWS = 2, 2
NOT_WORD = r"[^\p{L}\p{N}]+"

#: Public licence notices.
TEMPLATES = {
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0",
    "MIT-short": "Released under the MIT License",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0-short": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must "
    "retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
    "and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
    "License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
    "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def _words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), NOT_WORD), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """Hash of each run of SHINGLE words, in order."""
    n = F.size(words) - SHINGLE + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))))).otherwise(F.array().cast("array<bigint>"))


#: MinHash functions: a shingle's hash is even already, so flipping bits by a constant orders shingles anew.
MASKS = [random.Random(k).getrandbits(60) | (k << 61) for k in range(BANDS * ROWS)]
MASKS = [m - (1 << 64) if m >= 1 << 63 else m for m in MASKS]


def _width_of(shingles: int) -> int:
    return max(w for w, least in WIDTHS if shingles >= least)


def _with_minhashes(df: DataFrame, keep: list[str], widths: set[int]) -> DataFrame:
    """Adds m{width}_{k}: for each shingle of s, the k-th MinHash of the window that begins there. Each width is made of
    the one below, in a projection of its own."""
    row = F.monotonically_increasing_id()
    for width, narrow in ((4, 1), (8, 4)):
        if not any(w >= width for w in widths):
            break
        made = []
        for k, mask in enumerate(MASKS):
            # least() passes over the nulls beyond the end; slice() would copy the whole array for each window
            parts = ", ".join(f"get(s, i + {j}) ^ {mask}L" if narrow == 1 else f"get(m{narrow}_{k}, i + {j})" for j in range(0, width, narrow))
            made.append(F.expr(f"CASE WHEN size(s) > 0 THEN transform(sequence(0, size(s) - 1), i -> least({parts})) ELSE cast(array() AS array<bigint>) END").alias(f"m{width}_{k}"))
        kept = [c for c in df.columns if c in keep or c[0] in "mr"]
        # A row number that the filter asks for keeps the optimizer from copying the arrays' expressions into each
        # other's lambdas, where they would be computed once per element.
        df = df.select(*kept, *made, row.alias(f"r{width}"))
    return df


def _bands(width: int) -> list[str]:
    """The bands of a width's windows, an array each. A window of one shingle has one band, the shingle."""
    if width == 1:
        return ["s"]
    zipped = [", ".join(f"get(m{width}_{b * ROWS + r}, i)" for r in range(ROWS)) for b in range(BANDS)]
    return [f"CASE WHEN size(s) > 0 THEN transform(sequence(0, size(s) - 1), i -> xxhash64({width}, {b}, {z})) ELSE cast(array() AS array<bigint>) END" for b, z in enumerate(zipped)]


def catalogue(spark: SparkSession, templates: dict[str, str]) -> tuple[list[tuple[str, list[int]]], list[tuple[int, int]]]:
    """((name, distinct shingles) of each template), ((band, number of the template)). A few thousand numbers."""
    df = spark.createDataFrame([(k, n, t) for k, (n, t) in enumerate(templates.items())], "k int, name string, text string")
    df = df.select("k", "name", _words(F.col("text")).alias("w")).select("k", "name", _shingles(F.col("w")).alias("s"))
    df = _with_minhashes(df, ["k", "name", "s"], {w for w, _ in WIDTHS})
    names, bands = [], set()
    for r in df.select("k", "name", "s", *(F.expr(b).alias(f"b{w}_{j}") for w, _ in WIDTHS for j, b in enumerate(_bands(w)))).orderBy("k").collect():
        if not r["s"]:
            raise ValueError(f"template {r['name']} has fewer than {SHINGLE} words")
        width = _width_of(len(r["s"]))
        names.append((r["name"], sorted(set(r["s"]))))
        for j in range(1 if width == 1 else BANDS):
            bands |= {(v, r["k"], width) for v in r[f"b{width}_{j}"][: len(r["s"]) - width + 1]}
    return names, sorted(bands)


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, n_template, n_found for each template of which the text holds the threshold's share of shingles."""
    spark = docs.sparkSession
    result = "doc_id long, license string, n_template long, n_found long"
    templates = TEMPLATES if templates is None else templates
    if not templates:
        return spark.createDataFrame([], result)
    names, bands = catalogue(spark, templates)
    row = F.monotonically_increasing_id()
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), _words(whole_text(text_col)).alias("w"), row.alias("r0"))
    df = df.select("doc_id", _shingles(F.col("w")).alias("s"), "r0", row.alias("r1"))
    df = _with_minhashes(df, ["doc_id", "s"], {w for *_, w in bands})
    met = []
    for width in sorted({w for *_, w in bands}):
        wanted = ", ".join(f"{v}L" for v in sorted({v for v, _, w in bands if w == width}))
        met += [f"filter({b}, v -> v IN ({wanted}))" for b in _bands(width)]
    rows = [c for c in df.columns if c[0] == "r"]
    df = df.select("doc_id", "s", *rows, F.expr(f"array_distinct(concat({', '.join(met)}))").alias("met"), row.alias("row"))
    df = df.filter(" + ".join(rows) + " + row >= 0 AND size(met) > 0").select("row", "doc_id", "s", F.explode("met").alias("band"))
    by_band = spark.createDataFrame([(v, k) for v, k, _ in bands], "band long, k int").distinct()
    known = spark.createDataFrame([(k, n, len(s), s) for k, (n, s) in enumerate(names)], "k int, license string, n_template long, shingles array<long>")
    found = df.join(F.broadcast(by_band), "band").select("row", "k", "doc_id", "s").dropDuplicates(["row", "k"])
    both = found.join(F.broadcast(known), "k").withColumn("n_found", F.size(F.array_intersect("s", "shingles")).cast("long"))
    return both.filter(F.col("n_found") >= threshold * F.col("n_template")).select("doc_id", "license", "n_template", "n_found")
