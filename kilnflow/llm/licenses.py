"""License scans: MinHash over text windows finds templates, exact containment confirms them.

Documents and templates are cut into overlapping windows of words. A window's signature is
the minimum of each of ``BANDS`` hash functions over its shingles, one per band: a window
that holds a template's window meets it with probability 1 - (1 - J) ** BANDS, J the Jaccard
similarity of the two windows' shingles. For the shortest template (3 shingles in a window of
14) that is above 0.9999. What meets is confirmed by the share of the template's shingles
that the text contains. Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kilnflow.llm.common import documents, let

SHINGLE = 3
#: Words of a window, and from one window's start to the next.
WINDOW = 16
STRIDE = 8
BANDS = 48
CONTAINMENT = 0.8

# --- Fixed values: notices of public licenses ---------------------------------------------

TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-text": (
        "you may not use this file except in compliance with the License. You may obtain a copy of "
        "the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
        "law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-text": (
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation"
    ),
    "BSD-text": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met"
    ),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies"
    ),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."
    ),
}


@dataclass(frozen=True)
class Scan:
    """Window, bands and threshold of a scan."""

    window: int = WINDOW
    stride: int = STRIDE
    bands: int = BANDS
    containment: float = CONTAINMENT


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")


def shingles(word: Column) -> Column:
    """Hashes of all runs of ``SHINGLE`` words, in order; none in a shorter text."""
    return F.when(
        F.size(word) >= SHINGLE,
        F.transform(
            F.sequence(F.lit(0), F.size(word) - SHINGLE),
            lambda i: F.xxhash64(*(F.get(word, i + k) for k in range(SHINGLE))),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def windows(shingle: Column, scan: Scan) -> Column:
    """Start and shingles of every window; the last one may be short."""
    width = scan.window - SHINGLE + 1
    last = F.greatest(F.size(shingle) - width, F.lit(0))
    starts = F.transform(
        F.sequence(F.lit(0), F.ceil(last / scan.stride).cast("int")), lambda i: i * scan.stride
    )
    return F.transform(
        starts, lambda s: F.struct(s.alias("start"), F.slice(shingle, s + 1, F.lit(width)).alias("part"))
    )


def signature(part: Column, bands: int) -> Column:
    """The bands' keys of a window: band and least hash, as one hash each."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(bands - 1)),
        lambda b: F.xxhash64(b, F.array_min(F.transform(part, lambda s: F.xxhash64(s, b)))),
    )


def texts_of(word: Column) -> Column:
    """All runs of ``SHINGLE`` words as text, in order."""
    return F.when(
        F.size(word) >= SHINGLE,
        F.transform(
            F.sequence(F.lit(0), F.size(word) - SHINGLE),
            lambda i: F.concat_ws(" ", *(F.get(word, i + k) for k in range(SHINGLE))),
        ),
    ).otherwise(F.array().cast("array<string>"))


_TEMPLATE = "array<struct<license:string,keys:array<bigint>,all:array<string>>>"


def template_index(spark: SparkSession, templates: dict[str, str], scan: Scan) -> tuple[Column, Column]:
    """The templates as literals: each one's band keys and shingles, and the hashes of all shingles.

    A template is cut into windows at every word, so that a text's window that lies inside
    it is one of them. The index is as large as the list of templates, whatever the input.
    """
    schema = T.StructType([T.StructField(n, T.StringType(), False) for n in ("license", "template")])
    every = Scan(scan.window, 1, scan.bands)
    rows = (
        spark.createDataFrame(sorted(templates.items()), schema)
        .select("license", words(F.col("template")).alias("word"))
        .select("license", F.array_distinct(texts_of(F.col("word"))).alias("all"), shingles(F.col("word")).alias("hashes"))
        .filter(F.size("hashes") > 0)
        .select("license", "all", "hashes", F.array_distinct(keys_of(F.col("hashes"), every)).alias("keys"))
        .orderBy("license")
        .collect()
    )
    index = F.array(
        *(
            F.struct(
                F.lit(r["license"]).alias("license"),
                F.array(*map(F.lit, r["keys"])).alias("keys"),
                F.array(*map(F.lit, r["all"])).alias("all"),
            )
            for r in rows
        )
    ).cast(_TEMPLATE)
    hashes = sorted({h for r in rows for h in r["hashes"]})
    return index, F.array(*map(F.lit, hashes)).cast("array<bigint>")


def keys_of(shingle: Column, scan: Scan) -> Column:
    """Band keys of all windows."""
    return F.flatten(F.transform(windows(shingle, scan), lambda w: signature(w["part"], scan.bands)))


def licensed(docs: DataFrame, templates: dict[str, str] | None = None, scan: Scan = Scan()) -> DataFrame:
    """The licenses each whole text holds, one row per document and license.

    ``doc_id``, ``license``, ``containment`` (share of the template's distinct shingles that
    the text has) and ``first_word`` (number of words before the first of them). Null, empty
    and short texts hold none; equal rows give equal results, each its own.

    A text that has no shingle of any template can't meet one in a band, and is passed over
    before windows are cut. Everything happens within a row: nothing is shuffled.
    """
    index, hashes = template_index(docs.sparkSession, dict(TEMPLATES if templates is None else templates), scan)
    none = F.array().cast("array<struct<license:string,containment:double,first_word:bigint>>")

    def meeting(keys: Column) -> Column:
        return F.filter(index, lambda t: F.arrays_overlap(keys, t["keys"]))

    def confirmed(met: Column, texts: Column) -> Column:
        def measure(t: Column) -> Column:
            common = F.array_intersect(t["all"], texts)
            first = F.array_min(F.transform(common, lambda c: F.array_position(texts, c))) - 1
            return F.struct(
                t["license"].alias("license"),
                (F.size(common) / F.size(t["all"])).alias("containment"),
                first.cast("long").alias("first_word"),
            )

        return F.filter(F.transform(met, measure), lambda m: m["containment"] >= scan.containment)

    def scanned(word: Column, shingle: Column) -> Column:
        met = let(keys_of(shingle, scan), meeting)
        return let(met, lambda m: F.when(
            F.size(m) > 0, let(texts_of(word), lambda texts: confirmed(m, texts))
        ).otherwise(none))

    # One expression with its parts bound by let: as columns of their own they could be
    # copied into the functions that go through their elements.
    found = let(
        words(F.col("text")),
        lambda word: let(
            shingles(word),
            lambda shingle: F.when(F.arrays_overlap(shingle, hashes), scanned(word, shingle)).otherwise(none),
        ),
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.inline_outer(found)).filter(
        "license is not null"
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licensed(documents(spark, sf_dir))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OP3_SQL = f"""
with template(license, t) as (
  values {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in TEMPLATES.items())}
), worded as (
  select null::bigint as doc_id, license, list_filter(string_split_regex(lower(t), '[^a-z0-9]+'), lambda w: w <> '') as w
  from template
  union all
  select doc_id, null, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '')
  from documents
), shingled as (
  select doc_id, license,
    list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) as s
  from worded
), matched as (
  select d.doc_id, t.license, list_intersect(list_distinct(t.s), d.s) as common, len(list_distinct(t.s)) as n, d.s
  from shingled d join shingled t on d.license is null and t.license is not null
)
select doc_id, license, len(common) / n as containment,
  list_min(list_transform(common, lambda c: list_position(s, c)))::bigint - 1 as first_word
from matched where len(common) / n >= 0.8
"""
