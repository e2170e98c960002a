"""License scans with MinHash bands, in DataFrame functions only.

Texts are lower-cased words (digits, letters, anything not ASCII); five words are a shingle.
A template of m shingles belongs to the class c, the least power of two not below m. For
each class a text has windows of 2c shingles at every multiple of c, so every run of c
shingles lies whole in some window.

1. One pass over the texts keeps the places of shingles that some template has; a
   window without any has containment zero for every template.
2. A window's kept shingles get ``BANDS`` MinHash values, one a band; equal band values
   retrieve templates of the class. A window that holds 0.8 of a template and nothing of others
   has a similarity of 0.8. One filled up by other templates has 0.8 m / (2c + 0.2 m), over 0.19
   as m is over c/2: it is missed with probability 0.81 ** BANDS at most, under 2e-6.
3. A retrieved template matches if at least ``CONTAINED`` of its shingles stand in the window,
   counted exactly.

The template library is the only thing that is broadcast: a parameter of fixed size, checked
against ``LIBRARY`` shingles; beyond that the shingles of the texts are joined instead.
Null texts and texts under five words have no shingles. Rows equal in id and text get equal
results. Templates under five words are refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geofold.llm import _store

WORDS, CONTAINED, BANDS = 5, 0.8, 64
LIBRARY = 20_000
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Notices and headers of public licenses: fixed values.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
#: Creative Commons notices, by rule.
TEMPLATES += [
    (f"CC-{kind}-{version}", f"Licensed under CC {kind} {version}.")
    for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")
    for version in ("2.0", "2.5", "3.0", "4.0")
]


def tokens(text):
    return F.filter(F.split(F.lower(text), SPLIT), lambda w: w != "")


def shingles(words):
    """Hashes of the shingles of an array of words, in order."""
    n = F.size(words) - (WORDS - 1)
    hashed = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(WORDS)]))
    return F.when(n > 0, hashed).otherwise(F.array().cast("array<long>"))


def library(spark: SparkSession, templates=None) -> DataFrame:
    """(template, license, c, sh): a row per template with its distinct shingles, a bounded table."""
    templates = TEMPLATES if templates is None else templates
    rows = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, text string")
    rows = rows.select("template", "license", tokens(F.col("text")).alias("w")).select("template", "license", F.array_distinct(shingles(F.col("w"))).alias("sh"))
    short = rows.where(F.size("sh") == 0).count()
    if short:
        raise ValueError(f"{short} templates have fewer than {WORDS} words")
    power = F.ceil(F.log2(F.size("sh").cast("double")) - 1e-9).cast("int")
    return rows.withColumn("c", F.pow(F.lit(2.0), power).cast("int"))


def seeds(n: int) -> list[int]:
    out, x = [], 0x9E3779B97F4A7C15
    for _ in range(n):
        x = (x * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        out.append(x - (1 << 64) if x >= 1 << 63 else x)
    return out


def _turn(seed: int):
    """Another order of the hashes: a lambda of one argument."""
    return lambda x: x.bitwiseXOR(F.lit(seed))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=None, bands: int = BANDS, contained: float = CONTAINED, limit: int = LIBRARY) -> DataFrame:
    """(id, template, license, first, last, containment) per document and matching window."""
    return _matches(_hits(docs, id_col, text_col, templates, limit), templates, bands, contained).drop("key")


def _hits(docs, id_col, text_col, templates, limit) -> DataFrame:
    """(id, key, hits) of every row, written once: the places of shingles that templates have."""
    spark = docs.sparkSession
    known = library(spark, templates)
    known_set = [r["h"] for r in known.select(F.explode("sh").alias("h")).distinct().limit(limit + 1).collect()]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("key"), tokens(text).alias("w")).select("id", "key", shingles(F.col("w")).alias("sh"))
    pairs = F.transform("sh", lambda x, i: F.struct(i.alias("pos"), x.alias("h")))
    if len(known_set) <= limit:
        found = rows.select("id", "key", F.filter(pairs, lambda p: p["h"].isin(known_set)).alias("hits"))
    else:
        apart = rows.select("id", "key", F.explode(pairs).alias("p")).select("id", "key", "p.pos", "p.h")
        held = apart.join(known.select(F.explode("sh").alias("h")).distinct(), "h", "left_semi").groupBy("id", "key").agg(F.collect_set(F.struct("pos", "h")).alias("hits"))
        held = held.withColumnsRenamed({"id": "i2", "key": "k2"})
        found = rows.select("id", "key").join(held, F.col("id").eqNullSafe(F.col("i2")) & (F.col("key") == F.col("k2")), "left")
        found = found.select("id", "key", F.coalesce("hits", F.array().cast("array<struct<pos:int,h:bigint>>")).alias("hits"))
    return _store.written(found, "license-hit")


def _matches(hits: DataFrame, templates, bands: int, contained: float) -> DataFrame:
    spark = hits.sparkSession
    known = library(spark, templates)
    salt = seeds(bands)
    sizes = sorted(r["c"] for r in known.select("c").distinct().collect())
    one = hits.where(F.size("hits") > 0).select("id", "key", F.explode("hits").alias("p")).select("id", "key", "p.pos", "p.h")
    spots = [F.struct(F.lit(c).alias("c"), (F.floor(F.col("pos") / c) - back).cast("int").alias("k")) for c in sizes for back in (0, 1)]
    spread = one.select("id", "key", "pos", "h", F.explode(F.array(*spots)).alias("s")).select("id", "key", "pos", "h", "s.c", "s.k").where("k >= 0")
    windows = spread.groupBy("id", "key", "c", "k").agg(
        F.collect_set("h").alias("have"),  # at most 2c shingles
        F.min("pos").alias("first"), F.max("pos").alias("last"),
        *[F.min(F.col("h").bitwiseXOR(F.lit(s))).alias(f"m{j}") for j, s in enumerate(salt)],
    )
    keyed = F.explode(F.array(*[F.struct(F.lit(j).alias("band"), F.col(f"m{j}").alias("value")) for j in range(bands)]))
    asked = windows.select("id", "key", "c", "k", "have", "first", "last", keyed.alias("b")).select("id", "key", "c", "k", "have", "first", "last", "b.band", "b.value")
    minima = F.explode(F.array(*[F.struct(F.lit(j).alias("band"), F.array_min(F.transform("sh", _turn(s))).alias("value")) for j, s in enumerate(salt)]))
    table = known.select("template", "license", "c", "sh", minima.alias("b")).select("template", "license", "c", "sh", "b.band", "b.value")
    if known.count() <= LIBRARY:
        table = F.broadcast(table)
    share = F.size(F.array_intersect("have", "sh")) / F.size("sh")
    return (
        asked.join(table, ["c", "band", "value"])
        .groupBy("id", "key", "c", "k", "template", "license")
        .agg(F.first(share).alias("containment"), F.first("first").alias("first"), F.first("last").alias("last"))
        .where(F.col("containment") >= contained)
        .select("id", "key", "template", "license", "first", "last", "containment")
    )


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=None) -> DataFrame:
    """(id, n_licenses, licenses, best) of every row: the licenses found, sorted and joined by commas."""
    hits = _hits(docs, id_col, text_col, templates, LIBRARY)
    found = _matches(hits, templates, BANDS, CONTAINED)
    per = found.groupBy("id", "key").agg(F.sort_array(F.collect_set("license")).alias("names"), F.max("containment").alias("best")).withColumnsRenamed({"id": "i2", "key": "k2"})
    joined = hits.select("id", "key").join(per, F.col("id").eqNullSafe(F.col("i2")) & (F.col("key") == F.col("k2")), "left")
    return joined.select("id", F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_licenses"), F.coalesce(F.array_join("names", ","), F.lit("")).alias("licenses"), F.coalesce("best", F.lit(0.0)).alias("best"))
