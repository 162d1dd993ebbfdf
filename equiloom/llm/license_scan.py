"""License scans by MinHash bands, in DataFrame functions only.

Texts become lower-case words of letters and digits. For every template length
L, windows of 2 L words start at every L-th word, so that each run of L words
lies whole in one of them. A window whose shingles of five words meet none of
the templates' is no match; the others retrieve templates that share one of
BANDS least hashes. A whole template of at least five words is a sixth or more
of its window's shingles, so it is retrieved with probability 1 - (5/6) ** 64,
more than 0.99999. The exact containment of the template's shingles in the
window, CONTAINED or more, then decides.

Cases: a null or empty text matches nothing; a very long text is cut into
windows like any other; rows that repeat a doc_id are reported as one, by the
best of their texts; a template under five words is refused; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH, BANDS, CONTAINED = 5, 64, 0.8

_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_HEADER = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {} as published by the Free Software Foundation, "
    "either version {} of the License, or (at your option) any later version."
)

# Notices that licences ask to be shown, and the text of short ones.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
    f"this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies.",
    "BSD-2-text": _BSD,
    "BSD-3-text": _BSD + "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
    "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use "
    "of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by "
    "this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software",
    "GPL-3.0-header": _HEADER.format("GNU General Public License", "3"),
    "AGPL-3.0-header": _HEADER.format("GNU Affero General Public License", "3"),
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
    "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
    "You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
}


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}]+", " "), " "), "")


def _shingles(w: Column) -> Column:
    """Hashes of the runs of WIDTH words, in order."""
    hashed = F.transform(F.sequence(F.lit(0), F.size(w) - WIDTH), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WIDTH)]))
    return F.when(F.size(w) >= WIDTH, hashed).otherwise(F.array().cast("array<bigint>"))


def _least(h: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.array_min(F.transform(h, lambda x: F.xxhash64(x, i))))


def _templates(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license, size (words) and hashes of each template."""
    rows = F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("notice")) for k, v in sorted(templates.items())])
    read = spark.range(1).select(F.explode(rows).alias("r")).select("r.license", F.explode(F.array(_words(F.col("r.notice")))).alias("w"))
    return read.select("license", F.size("w").alias("size"), F.array_distinct(_shingles(F.col("w"))).alias("wanted"))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, containment (greatest) and first_word (of the first
    window that reaches it) for each match."""
    known = _templates(docs.sparkSession, templates or TEMPLATES)
    listed = known.collect()  # as many as the templates given
    if any(r["size"] < WIDTH for r in listed):
        raise ValueError(f"a template needs {WIDTH} words")
    of = lambda rows: F.array(*[F.lit(x) for x in sorted({x for r in rows for x in r.wanted})])
    sizes = sorted({r["size"] for r in listed})
    read = docs.select("doc_id", F.explode(F.array(_words(F.coalesce("text", F.lit(""))))).alias("w"))
    hashed = read.select("doc_id", F.size("w").alias("n"), F.explode(F.array(_shingles(F.col("w")))).alias("h")).where(F.arrays_overlap("h", of(listed)))
    windows = F.array(*[F.struct(F.lit(s).alias("size"), of([r for r in listed if r["size"] == s]).alias("some")) for s in sizes])
    cut = (
        hashed.select("doc_id", "n", "h", F.explode(windows).alias("c"))
        .select("doc_id", "h", "c", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / F.col("c.size")).cast("int"))).alias("i"))
        .select("doc_id", "c", (F.col("i") * F.col("c.size")).alias("at"), F.slice("h", F.col("i") * F.col("c.size") + 1, 2 * F.col("c.size") - WIDTH + 1).alias("h"))
        .where(F.arrays_overlap("h", "c.some"))
        .select("doc_id", F.col("c.size").alias("size"), "at", "h")
    )
    bands = cut.select("doc_id", "size", "at", "h", F.posexplode(_least(F.col("h"))).alias("band", "key"))
    wanted = known.select("license", "size", "wanted", F.posexplode(_least(F.col("wanted"))).alias("band", "key"))
    met = bands.join(wanted, ["size", "band", "key"]).groupBy("doc_id", "license", "at").agg(
        F.max(F.size(F.array_intersect("wanted", "h")) / F.size("wanted")).alias("containment")
    )
    found = met.where(F.col("containment") >= CONTAINED)
    return found.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min("at").cast("long").alias("first_word"))


def oracle(templates: dict[str, str] | None = None) -> str:
    """The same windows and containment in DuckDB SQL, over all templates."""
    given = ", ".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in sorted((templates or TEMPLATES).items()))
    words = lambda x: f"[x FOR x IN string_split(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' ') IF x <> '']"
    grams = f"CASE WHEN len(w) >= {WIDTH} THEN [array_to_string(w[i:i + {WIDTH - 1}], ' ') FOR i IN range(1, len(w) - {WIDTH - 2})] ELSE [] END"
    return f"""
WITH t AS (SELECT license, {words('notice')} AS w FROM (VALUES {given}) v(license, notice)),
q AS (SELECT license, len(w) AS size, list_distinct({grams}) AS wanted FROM t),
a AS (SELECT DISTINCT unnest(wanted) AS g FROM q),
d AS (SELECT doc_id, {words("coalesce(text, '')")} AS w FROM documents),
h AS (SELECT doc_id, len(w) AS n, {grams} AS h FROM d),
g AS (SELECT * FROM h WHERE list_has_any(h, (SELECT list(g) FROM a))),
c AS (SELECT doc_id, license, size, wanted, h, unnest(range(0, (n - 1) // size + 1)) * size AS pos FROM g, q),
m AS (SELECT doc_id, license, pos, len(list_intersect(wanted, h[pos + 1:pos + 2 * size - {WIDTH - 1}])) / len(wanted)::DOUBLE AS containment FROM c)
SELECT doc_id, license, max(containment) AS containment, min(pos)::BIGINT AS first_word FROM m WHERE containment >= {CONTAINED} GROUP BY ALL"""
