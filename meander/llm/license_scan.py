"""Licences in texts: MinHash bands retrieve templates, shingle containment verifies them.

Texts and templates are lower-cased and split at every ASCII character that is
no letter or digit; a shingle is five words.  The windows of a text overlap:
for a template of s shingles one of s shingles starts at every place.  Each of ``BANDS`` bands is the smallest value of one
hash function over the window; a window retrieves the templates that agree
with it in any band.  A window that holds three quarters of a template has a
Jaccard similarity of 0.6 with it or more, so some band agrees with
probability 1 - 0.4 ** BANDS = 0.9997.  A retrieved window counts if it really
holds at least ``PERCENT`` of the template's shingles.

A band agrees only where the window holds the very shingle that is smallest in
the template, so windows without such a shingle aren't spelled out.  Everything
is built-in functions; templates are a parameter, a list of bounded size.

Cases: a null text, or one of fewer than five words, has no licence.  Each row
is scanned by itself, also when rows repeat.  Templates of fewer than five
words are refused.  An empty table gives an empty one.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

SHINGLE, PERCENT, BANDS = 5, 75, 9
# A parameter as table: licence to a line that tells of it.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "apache-2.0-notice": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
_SPLIT = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def template_words(text: str) -> list[str]:
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower()) if w]


def _template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license, s, shingles, keys (a band's smallest hash each), anchors (the shingles these are of)."""
    rows = [(name, template_words(text)) for name, text in templates.items()]
    if any(len(w) < SHINGLE for _, w in rows):
        raise ValueError(f"a template has fewer than {SHINGLE} words")
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = ", ".join(f"({quoted(name)}, array({', '.join(map(quoted, words))}))" for name, words in rows)
    table = spark.sql(f"SELECT * FROM VALUES {values} AS templates(license, words)")
    table = table.selectExpr("license", f"array_distinct(transform(sequence(1, size(words) - {SHINGLE - 1}), i -> xxhash64(slice(words, i, {SHINGLE})))) AS shingles")
    best = f"transform(sequence(0, {BANDS - 1}), k -> array_min(transform(shingles, x -> struct(xxhash64(x, k) AS h, x))))"
    return table.selectExpr("license", "size(shingles) AS s", "shingles", f"{best} AS best").selectExpr(
        "license", "s", "shingles", "best.h AS keys", "array_distinct(best.x) AS anchors")


def license_matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES, percent: int = PERCENT,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, license, first_word, containment, n_windows: each licence of each row.

    first_word: where (in words, from 0) the first window of the largest containment begins.
    """
    spark = docs.sparkSession
    table = _template_table(spark, templates)
    known = table.collect()  # as many rows as templates
    reach = max(r["s"] for r in known)
    anchors = sorted({a for r in known for a in r["anchors"]})
    listed = ", ".join(f"{a}L" if a > -(1 << 63) else "CAST('-9223372036854775808' AS BIGINT)" for a in anchors)
    # The words are bound once for all places; a hit keeps the words that a window on it can reach.
    words = f"filter(split(lower(t), '{_SPLIT}'), w -> w <> '')"
    hits = (f"filter(transform(sequence(1, size(w) - {SHINGLE - 1}), i -> struct(i, xxhash64(slice(w, i, {SHINGLE})) AS h)), x -> x.h IN ({listed}))")
    around = (f"transform({hits}, x -> struct(x.i AS at, x.h AS h, greatest(1, x.i - {reach - 1}) AS low, "
              f"slice(w, greatest(1, x.i - {reach - 1}), x.i - greatest(1, x.i - {reach - 1}) + {reach + SHINGLE - 1}) AS near))")
    found = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("t")).where("t is not null")
    found = found.select("doc_id", "row", F.explode(F.expr(
        f"element_at(transform(array({words}), w -> IF(size(w) < {SHINGLE}, NULL, {around})), 1)")).alias("hit")).select("doc_id", "row", "hit.*")
    found = found.withColumn("hashes", F.expr(f"transform(sequence(1, size(near) - {SHINGLE - 1}), i -> xxhash64(slice(near, i, {SHINGLE})))"))
    anchored = F.broadcast(table.select("license", "s", "shingles", "keys", F.explode("anchors").alias("h")))
    # Windows of s shingles that hold the hit; a short text's only window is all it has.
    found = found.join(anchored, "h").withColumn("length", F.expr("least(s, size(hashes))"))
    first, last = "greatest(1, at - low + 2 - length)", "least(at - low + 1, size(hashes) - length + 1)"
    found = found.where(f"{first} <= {last}").withColumn("begin", F.explode(F.expr(f"sequence({first}, {last})")))
    found = found.withColumn("window", F.expr("slice(hashes, begin, length)"))
    bands = f"transform(sequence(0, {BANDS - 1}), k -> array_min(transform(window, x -> xxhash64(x, k))))"
    found = found.where(F.expr(f"exists(zip_with({bands}, keys, (a, b) -> a = b), x -> x)"))
    held = F.expr("size(array_intersect(window, shingles))")
    found = found.withColumn("held", held).where(f"100 * held >= {percent} * s")
    return (found.select("doc_id", "row", "license", (F.col("begin") + F.col("low") - 2).alias("first"), (F.col("held") / F.col("s")).alias("containment")).distinct()
            .groupBy("doc_id", "row", "license").agg(F.min(F.struct(-F.col("containment"), F.col("first"))).alias("best"),
                                                    F.max("containment").alias("containment"), F.count("*").alias("n_windows"))
            .select("doc_id", "license", F.col("best.first").cast("long").alias("first_word"), "containment", "n_windows"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
