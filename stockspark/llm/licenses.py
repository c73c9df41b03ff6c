"""License scan: MinHash bands over overlapping windows, exact containment; DataFrame functions only.

Texts and license templates become lower-cased words without outer punctuation
and their 5-word shingles (64-bit hashes). A template of n shingles belongs to
the size class m, the power of two from n up; a text's windows of that class hold
2m shingles and start at every multiple of m, so a passage of up to m shingles
lies inside one. Each window and template is sketched by ``BANDS`` MinHash
values, each a band of its own. If a window holds 75 % of a template, the two
have a similarity of at least 0.375 m / (2 m + 0.125 m) = 0.176, and share a band
with probability 1 - 0.824^64 > 0.99999. What the bands retrieve is verified by
the exact share of the template's shingles in the window.

A window without any template shingle cannot pass; texts without one are not
sketched.

Null and short texts (under five words) hold no license; templates of under five
words are not allowed. A null doc_id is reported as null. Repeated rows are
reported once. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockspark.llm.common import documents, let, prepare, words_of

SHINGLE = 5
PERCENT = 75
BANDS = 64
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Notices of public licenses, by SPDX name.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
            "Free Software Foundation"),
    ("LGPL", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def shingles(text: Column) -> Column:
    """array<bigint> of a text's 5-word shingles, in order."""
    words = F.filter(F.transform(words_of(text), lambda x: F.btrim(F.lower(x), F.lit(PUNCTUATION))), lambda c: c != "")

    def of(h: Column) -> Column:
        n = F.size(h) - SHINGLE + 1
        made = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, SHINGLE)))
        return F.when(n > 0, made).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def min_hashes(s: Column) -> Column:
    """BANDS values: the smallest hash of the shingles under each seed."""
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)),
                       lambda seed: F.array_min(F.transform(s, lambda x: F.xxhash64(seed, x))))


def templates(spark: SparkSession, notices=None) -> DataFrame:
    """(template, license, wanted shingles, n, m): one row per notice."""
    rows = [(i, name, text) for i, (name, text) in enumerate(notices or TEMPLATES)]
    made = spark.createDataFrame(rows, "template int, license string, text string")
    made = made.withColumn("wanted", F.array_distinct(shingles(F.col("text")))).withColumn("n", F.size("wanted"))
    return made.select("template", "license", "wanted", "n",
                       F.expr("cast(pow(2, ceil(log2(n))) as int)").alias("m"))


def windows(docs: DataFrame, wanted: list[int], classes: list[int]) -> DataFrame:
    """(doc_id, m, start, held): every window of every size class of the texts that
    hold a wanted shingle."""
    found = (docs.select("doc_id", shingles(docs["text"]).alias("_s"))
             .where(F.arrays_overlap("_s", F.array(*[F.lit(x).cast("bigint") for x in wanted]))))

    def of(m: int) -> Column:
        starts = F.sequence(F.lit(0), F.size("_s") - 1, F.lit(m))
        return F.transform(starts, lambda p: F.struct(F.lit(m).alias("m"), p.alias("start")))

    placed = found.withColumn("_w", F.explode(F.concat(*[of(m) for m in classes])))
    cut = F.slice("_s", F.col("_w.start") + 1, F.col("_w.m") * 2)
    return (placed.select("doc_id", F.col("_w.m").alias("m"), F.col("_w.start").alias("start"),
                          F.array_distinct(cut).alias("held"))
            .where(F.arrays_overlap("held", F.array(*[F.lit(x).cast("bigint") for x in wanted]))))


def scan(docs: DataFrame, notices=None) -> DataFrame:
    """(doc_id, license, n_found, n_template, start): licenses of every text, each by its
    best matched notice: the most complete, then the longest, then the first in the text.
    Of notices matched in one window only the most complete count."""
    spark = docs.sparkSession
    prepare(spark)
    known = templates(spark, notices)
    rows = known.collect()  # the fixed list
    wanted = sorted({x for r in rows for x in r["wanted"]})
    classes = sorted({r["m"] for r in rows})
    seen = windows(docs, wanted, classes)
    key = ["doc_id", "m", "start"]
    theirs = known.select("template", "m", F.posexplode(min_hashes(F.col("wanted"))).alias("band", "value"))
    mine = seen.select(*key, "held", F.posexplode(min_hashes(F.col("held"))).alias("band", "value"))
    retrieved = mine.join(F.broadcast(theirs), ["m", "band", "value"]).select(*key, "template", "held").distinct()
    both = F.size(F.array_intersect("held", "wanted"))
    verified = (retrieved.join(F.broadcast(known.drop("m")), "template").withColumn("both", both)
                .where(F.col("both") * 100 >= F.col("n") * PERCENT).withColumn("share", F.col("both") / F.col("n"))
                .withColumn("_top", F.max("share").over(Window.partitionBy(*key))).where("share = _top"))
    best = F.max(F.struct(F.col("share"), F.col("n"), (-F.col("start")).alias("at"), F.col("both")))
    return (verified.groupBy("doc_id", "license").agg(best.alias("b"))
            .select("doc_id", "license", F.col("b.both").cast("long").alias("n_found"), F.col("b.n").cast("long").alias("n_template"),
                    (-F.col("b.at")).cast("long").alias("start")))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return scan(documents(spark, sf_dir))


_P = r"[!-/:-@\[-`{-~]"
_LIST = ",\n".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(TEMPLATES))


def _shingle_sql(source: str) -> str:
    return rf"""
  SELECT id, i, ws[i + 1:i + {SHINGLE}] AS g
  FROM (SELECT id, ws, unnest(range(0, len(ws) - {SHINGLE} + 1)) AS i
        FROM (SELECT id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'),
                                                    lambda x: regexp_replace(lower(x), '^{_P}+|{_P}+$', '', 'g')),
                                     lambda x: x <> '') AS ws FROM ({source})) WHERE len(ws) >= {SHINGLE})"""


OP3_SQL = rf"""
WITH notices(id, license, text) AS (VALUES {_LIST}),
want AS (SELECT DISTINCT id AS template, g FROM ({_shingle_sql('SELECT id, text FROM notices')})),
known AS (SELECT template, count(*) AS n, pow(2, ceil(log2(count(*))))::BIGINT AS m FROM want GROUP BY template),
hits AS (SELECT d.id AS doc_id, d.i, w.template, w.g, n, m
         FROM ({_shingle_sql('SELECT doc_id AS id, text FROM documents')}) d JOIN want w ON d.g = w.g
         JOIN known USING (template)),
placed AS (SELECT doc_id, template, n, m, g, (i // m) * m AS start FROM hits
           UNION SELECT doc_id, template, n, m, g, (i // m - 1) * m FROM hits WHERE i >= m),
held AS (SELECT doc_id, template, n, m, start, count(DISTINCT g) AS found FROM placed GROUP BY ALL
         HAVING 100 * count(DISTINCT g) >= {PERCENT} * n),
best AS (SELECT doc_id, license, found, n, start,
                row_number() OVER (PARTITION BY doc_id, license ORDER BY found / n DESC, n DESC, start, found DESC) AS k
         FROM (SELECT *, max(found / n) OVER (PARTITION BY doc_id, m, start) AS top FROM held) JOIN notices ON template = id
         WHERE found / n = top)
SELECT doc_id, license, found::BIGINT AS n_found, n::BIGINT AS n_template, start::BIGINT AS start FROM best WHERE k = 1
"""
