"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Words are runs of a-z and 0-9 of the lower-cased text, shingles five of them.  Templates are put in
classes by shingle count (powers of two, m); a document's windows for class m are 2m shingles long
(1 for m = 1) and start every m / 2, so any stretch of up to 1.5 m shingles lies inside one of them.
A window with containment >= 0.8 of a template of the class has Jaccard >= 0.19 with it; 64 bands of
one row find it with probability above 1 - 2e-6.  A candidate counts if its window holds at least 80 % of
the template's distinct shingles.  Windows without any shingle of any template cannot match and are
left out before hashing, which changes no result.

Everything is built-in functions; the template tables are constants of the program.

Edge cases: null text and texts of under five words have no shingles and no match; a template of under five words is an
error; a license said
several times is one row, with its first best window; repeated rows are found each; a text may hold
several licenses; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

WIDTH, PERCENT, BANDS = 5, 80, 64
WORD = "[a-z0-9]+"
#: fixed values: license notices as their holders publish them
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
}


def template_shingles(text: str) -> list[str]:
    w = re.findall(WORD, text.lower())
    return sorted({" ".join(w[i : i + WIDTH]) for i in range(len(w) - WIDTH + 1)})


def size_class(n: int) -> tuple[int, int, int]:
    """(m, window length, step) for a template of n shingles."""
    m = 1 << (n - 1).bit_length()
    return m, 1 if m == 1 else 2 * m, max(1, m // 2)


def shingle_hash(w: Column, i: Column) -> Column:
    return F.xxhash64(*(F.get(w, i + j) for j in range(WIDTH)))


def template_table(spark: SparkSession, templates: dict[str, str]) -> tuple[DataFrame, list[int]]:
    """(license, m, items, size) and all shingle hashes, hashed by the same expressions as documents."""
    rows = [(name, *size_class(len(s)), s) for name, text in templates.items() if (s := template_shingles(text))]
    if short := sorted(templates.keys() - {r[0] for r in rows}):
        raise ValueError(f"templates of under {WIDTH} words cannot be found: {', '.join(short)}")
    df = spark.createDataFrame(rows, "license string, m int, length int, step int, shingles array<string>")
    df = df.withColumn("items", F.transform("shingles", lambda s: shingle_hash(F.split(s, " "), F.lit(0)))).select("license", "m", "length", "step", "items", F.size("items").alias("size"))
    return df, sorted({h for r in df.select("items").collect() for h in r["items"]})  # constants of the program


def band_keys(items: Column) -> Column:
    def low(b: int) -> Column:
        return F.array_min(F.transform(items, lambda x: F.xxhash64(x, F.lit(b))))

    return F.array(*(F.struct(F.lit(b).alias("band"), low(b).alias("low")) for b in range(BANDS)))


def scan(docs: DataFrame, id_col: str = "doc_id", templates: dict[str, str] | None = None) -> DataFrame:
    """id, license, containment, first_shingle (where the best window starts), one row per document and license."""
    spark = docs.sparkSession
    known, hashes = template_table(spark, templates or TEMPLATES)
    kinds = sorted({size_class(len(template_shingles(t))) for t in (templates or TEMPLATES).values() if template_shingles(t)})
    rows = docs.select(F.monotonically_increasing_id().alias("_rid"), F.col(id_col).alias("id"), F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"({WORD})")).alias("w"))
    n = F.size("w") - WIDTH + 1
    h = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: shingle_hash(F.col("w"), i)))
    known_shingle = lambda x: x.isin(hashes)
    rows = rows.select("_rid", "id", h.alias("h")).where(F.exists("h", known_shingle))
    # positions of template shingles, then only the windows that cover one
    rows = rows.withColumn("hits", F.filter(F.transform("h", lambda x, i: F.when(known_shingle(x), i)), lambda i: i.isNotNull()))

    def starts(length: int, step: int) -> Column:
        return F.array_distinct(F.flatten(F.transform("hits", lambda p: F.transform(F.sequence(F.greatest(F.lit(0), F.ceil((p - length + 1) / step)).cast("int"), F.floor(p / step).cast("int")), lambda k: k * step))))

    def of_class(m: int, length: int, step: int) -> Column:
        return F.transform(starts(length, step), lambda s: F.struct(F.lit(m).alias("m"), s.alias("start"), F.lit(length).alias("length")))

    windows = F.concat(*(of_class(*k) for k in kinds))
    rows = rows.select("_rid", "id", "h", F.explode(windows).alias("v"))
    rows = rows.select("_rid", "id", "v.m", "v.start", F.array_distinct(F.slice("h", F.col("v.start") + 1, F.col("v.length"))).alias("items"))
    banded = rows.select("*", F.explode(band_keys(F.col("items"))).alias("b"))
    marks = F.broadcast(known.select("license", "m", F.col("items").alias("t_items"), "size", F.explode(band_keys(F.col("items"))).alias("b")))  # constants
    found = banded.join(marks, ["m", "b"]).withColumn("common", F.size(F.array_intersect("items", "t_items"))).where(F.col("common") * 100 >= F.col("size") * PERCENT)
    best = found.groupBy("_rid", "id", "license").agg(F.max(F.struct(F.col("common"), (-F.col("start")).alias("start"), "size")).alias("x"))
    return best.select(F.col("id").alias(id_col), "license", (F.col("x.common") / F.col("x.size")).alias("containment"), (-F.col("x.start")).cast("long").alias("first_shingle"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op3_license_scan": op3_license_scan}


def _sql() -> str:
    """Containment of every window that holds a template shingle, without any hashing."""
    quote = lambda s: s.replace("'", "''")
    rows = ", ".join(f"('{name}', {length}, {step}, {len(s)}, '{quote(x)}')" for name, text in TEMPLATES.items() if (s := template_shingles(text)) for _, length, step in [size_class(len(s))] for x in s)
    joined = " || ' ' || ".join(f"w[i + {j}]" for j in range(WIDTH))
    return f"""
WITH t(license, length, step, size, s) AS (VALUES {rows}),
d AS (SELECT doc_id, regexp_extract_all(translate(text, '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}'), '{WORD}') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - {WIDTH - 2})) AS i FROM d),
h AS (SELECT doc_id, i - 1 AS pos, {joined} AS s FROM p),
m AS (SELECT doc_id, license, length, step, size, pos, t.s FROM h JOIN t ON h.s = t.s),
v AS (SELECT *, unnest(range(CAST(greatest(0, ceil((pos - length + 1) / step)) AS BIGINT), CAST(floor(pos / step) AS BIGINT) + 1)) * step AS start FROM m),
c AS (SELECT doc_id, license, size, start, count(DISTINCT s) AS common FROM v GROUP BY ALL HAVING count(DISTINCT s) * 100 >= size * {PERCENT})
SELECT doc_id, license, max(common) / max(size) AS containment, CAST(arg_min(start, (-common, start)) AS BIGINT) AS first_shingle FROM c GROUP BY doc_id, license"""


ORACLE = {"op3_license_scan": _sql()}
