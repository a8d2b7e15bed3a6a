"""License scans (operator 2): MinHash bands over overlapping windows, in DataFrame functions.

A template of m five-word shingles is looked for in windows of three strides, a stride
being half of m, so that any m shingles in a row lie in one window. A window and a template
that agree on a band, the least of their shingles' hashes by one of BANDS functions, are
alike. A window can only agree if it has the template's least shingle: those shingles
are the index, and windows around them are the only ones whose bands are compared. For
the documents and templates retrieved, a sweep over the template's shingles in the
document gives the exact best window.

A window with four fifths of a template's shingles has a Jaccard similarity of
0.8 / (1.5 + 0.2) = 0.47 or more, of 1 / 3 for a template of one shingle. Of 24 bands one
agrees with probability 1 - 0.53^24 > 0.9999997, and 1 - (2/3)^24 > 0.9999 for one shingle.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.common import NOT_ALNUM, ascii_lower, materialize, words_of

SHINGLE, BANDS, CONTAINMENT = 5, 24, 0.8
#: Public license notices, by SPDX identifier and, where there are more, the part quoted. Whole texts are in license_texts.
#: Notices of fewer than five words have no shingle and can't be told from other text; there are none.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Whole texts by name, "<SPDX identifier> text", beside the notices.
TEMPLATES = NOTICES | {f"{p.stem} text": p.read_text(encoding="utf-8") for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
#: Templates up to which the index, BANDS rows of 40 bytes for each, is broadcast; beyond, the join shuffles.
BROADCAST_TEMPLATES = 20_000
#: Documents with an indexed shingle up to which their ids are broadcast to find their texts; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000


def _shingles(hashes: str) -> str:
    """Hashes of all five consecutive words, from the words' hashes."""
    parts = ", ".join(f"{hashes}[i + {j}]" for j in range(SHINGLE))
    return f"IF(size({hashes}) < {SHINGLE}, CAST(array() AS ARRAY<BIGINT>), transform(sequence(0, size({hashes}) - {SHINGLE}), i -> xxhash64({parts})))"


def _own(rows: DataFrame, text: str, *names: str) -> DataFrame:
    hashed = rows.select(*names, F.transform(words_of(ascii_lower(F.col(text)), NOT_ALNUM), lambda w: F.xxhash64(w)).alias("words"))
    return hashed.select(*names, F.size("words").alias("size"), F.expr(_shingles("words")).alias("own"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and license found: id, license, containment, first_word, n_words.

    Words are runs of a-z, 0-9 and non-ASCII characters once A-Z is lower case; n_words is
    the window's length, the template's. containment is the greatest share of the
    template's five-word shingles that a window has, from `containment` on; first_word is
    the first such window's first word, from 0. Null, empty and short texts have no license.
    Repeated rows with equal ids and texts give their licenses once; a null id is an id of
    its own; an empty table gives an empty result; extra columns are not read. Templates of
    fewer than five words are found nowhere; without templates the result is empty.
    """
    spark = docs.sparkSession
    named = TEMPLATES if templates is None else templates
    wanted = materialize(_own(spark.createDataFrame(list(named.items()), "license string, text string"), "text", "license"), "shingles")
    wanted = materialize(wanted.filter("size(own) > 0").select("license", F.col("size").alias("n_words"), F.size("own").alias("m"), F.array_distinct("own").alias("own")), "templates")
    least = f"transform(sequence(0, {BANDS - 1}), j -> array_min(transform(own, x -> named_struct('least', xxhash64(x, j), 'x', x, 'band', j))))"
    index = wanted.select("license", F.expr("(m + 1) div 2").cast("int").alias("stride"), F.explode(F.expr(least)).alias("b")).select("license", "stride", "b.*")

    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    # An explode of the bare column would bring a filter on its size, which is pushed below and splits the text again for every shingle.
    places = _own(texts, "text", "id", "key").select("id", "key", F.posexplode(F.slice("own", 1, 2**31 - 1)).alias("p", "x"))
    held = places.join(F.broadcast(index) if len(named) <= BROADCAST_TEMPLATES else index, "x")
    # The windows that have the shingle: at most three, and each band asks for them once.
    asked = held.withColumn("window", F.explode(F.expr("sequence(greatest(p div stride - 2, 0), p div stride)"))).select("id", "key", F.struct("license", "stride", "band", "least", "window").alias("asked"))
    asked = materialize(asked.groupBy("id", "key").agg(F.collect_set("asked").alias("asked")), "asked")  # of one document
    who = asked.select(F.col("id").alias("a_id"), F.col("key").alias("a_key"))
    same = F.col("id").eqNullSafe(F.col("a_id")) & (F.col("key") == F.col("a_key"))
    near = texts.join(F.broadcast(who) if asked.count() <= BROADCAST_ROWS else who, same, "left_semi")
    near = materialize(_own(near, "text", "id", "key").dropDuplicates(["id", "key"]), "near")

    alike = "filter(asked, a -> NOT exists(slice(own, int(a.window * a.stride + 1), 3 * a.stride), x -> xxhash64(x, a.band) < a.least))"
    found = near.join(asked.withColumnsRenamed({"id": "a_id", "key": "a_key"}), same).select("id", "key", "own", F.expr(f"array_distinct(transform({alike}, a -> a.license))").alias("licenses"))
    found = materialize(found, "found")
    pairs = found.select("id", "key", F.explode("licenses").alias("license"))
    at = found.select("id", "key", F.posexplode("own").alias("p", "x"))
    of_template = wanted.select("license", "n_words", "m", F.size("own").alias("of"), F.explode("own").alias("x"))
    hits = at.join(of_template, "x").join(pairs.select(F.col("id").alias("a_id"), F.col("key").alias("a_key"), F.col("license").alias("a_license")), same & (F.col("license") == F.col("a_license")), "left_semi")

    # A place counts for the windows that have it and no earlier place of its shingle. Their
    # first shingles are from `begin` on up to the place: sums of these steps are the counts.
    # All windows here are over one document.
    group = ["id", "key", "license", "n_words", "m", "of"]
    before = F.lag("p").over(Window.partitionBy(*group, "x").orderBy("p"))
    steps = hits.withColumn("begin", F.greatest(F.coalesce(before + 1, F.lit(0)), F.expr("p - m + 1"), F.lit(0)))
    steps = steps.select(*group, F.explode(F.expr("array(named_struct('s', begin, 'd', 1L), named_struct('s', p + 1, 'd', -1L))")).alias("e")).select(*group, "e.*").groupBy(*group, "s").agg(F.sum("d").alias("d"))
    counts = steps.withColumn("common", F.sum("d").over(Window.partitionBy(*group).orderBy("s").rowsBetween(Window.unboundedPreceding, 0)))
    best = counts.groupBy(*group).agg(F.max(F.struct("common", (-F.col("s")).alias("back"))).alias("m_")).filter(F.col("m_.common") >= F.lit(containment) * F.col("of"))
    return best.select(F.col("id").alias(id_col), "license", F.round(F.col("m_.common") / F.col("of"), 6).alias("containment"), (-F.col("m_.back")).alias("first_word"), "n_words")


def _oracle() -> str:
    quoted = [(k, v.replace("'", "''")) for k, v in TEMPLATES.items()]
    rows = ", ".join(f"('{k}', '{v}')" for k, v in quoted)
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH t AS (SELECT license, {words} AS w FROM (VALUES {rows}) v(license, text)),
ts AS (SELECT DISTINCT license, len(w) AS n, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT license, w, unnest(generate_series(1, len(w) - 4)) AS i FROM t)),
size AS (SELECT license, n, count(*) AS m FROM ts GROUP BY ALL),
d AS (SELECT doc_id, {words} AS w FROM documents),
ds AS (SELECT doc_id, i, len(w) AS total, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) > 4)),
hit AS (SELECT doc_id, i, total, license, n, s FROM ds JOIN ts USING (s)),
enough AS (SELECT doc_id, license FROM hit JOIN size USING (license) GROUP BY doc_id, license HAVING count(DISTINCT s) >= 0.8 * any_value(m)),
win AS (SELECT doc_id, license, n, st, count(DISTINCT s) AS common FROM (SELECT *, unnest(generate_series(greatest(i - n + 5, 1), i)) AS st FROM hit SEMI JOIN enough USING (doc_id, license)) GROUP BY ALL),
best AS (SELECT doc_id, license, win.n AS n, m, common, st, row_number() OVER (PARTITION BY doc_id, license ORDER BY common DESC, st) AS k
         FROM win JOIN size USING (license) WHERE common >= 0.8 * m)
SELECT doc_id, license, round(common / m, 6) AS containment, CAST(st - 1 AS INTEGER) AS first_word, CAST(n AS INTEGER) AS n_words FROM best WHERE k = 1
"""


ORACLE_SQL = _oracle()
