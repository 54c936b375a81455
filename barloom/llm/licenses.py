"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance along directories.

DataFrame operations only. Headers are the sentences of a file that mention licensing; a licence file (by its name) is
also taken whole. Equal pieces are counted and scored once. Term weights come from all pieces of all files and the
templates. A file without a licence of its own inherits from the licence file of its nearest ancestor directory.

Cases: null and empty texts have no pieces. Very long texts are taken whole; their pieces go by md5 where they need not be read. A null path belongs to no directory: it neither inherits nor gives. Of several
licence files in one directory the best score wins, then the smallest name and path. Rows with equal paths keep a row
each. An empty table gives an empty result. Other columns are kept out of the joins, so their names may clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import Scratch

#: Template texts by licence: fixed values.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain worldwide under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("All-Rights-Reserved", "All rights reserved."),
]
MENTION = r"(?i)licen[cs]e|copyright|rights reserved|spdx|permission is hereby|creative commons|public domain|redistribution and use"
FILE_NAME = r"(?i)^(licen[cs]e|copying|unlicense)"
TERM = "[a-z0-9]+(?:[.][0-9]+)*"
THRESHOLD = 0.6
#: Terms of one in so many rows or more are broadcast with their weights.
FREQUENT = 10_000


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _counted(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, term, tf): how often each piece has each term."""
    return rows.select(*key, F.explode(_terms(F.col("piece"))).alias("term")).groupBy(*key, "term").agg(F.count(F.lit(1)).alias("tf"))


def scored_pieces(pieces: DataFrame, threshold: float = THRESHOLD, share: int = FREQUENT, scratch: Scratch | None = None) -> DataFrame:
    """(pid, piece, n): distinct pieces, their md5 and numbers -> pid, license, score of those near a template.

    idf = ln((1 + N) / (1 + df)) + 1, over all pieces and templates. Terms of templates, and terms that take one in
    ``share`` of all (piece, term) rows or more, meet their weights by broadcast: they number at most ``share`` and the terms
    of the fixed templates. The others are joined by term, and none of them is hot. Only terms of templates enter products; of
    all others a piece needs but the sum of squares.
    """
    spark, scratch = pieces.sparkSession, scratch or Scratch(pieces.sparkSession)
    templates = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(TEMPLATES)], "tpl int, license string, piece string")
    tf = scratch.write(_counted(pieces, ["pid", "n"]))
    tpl = _counted(templates, ["tpl", "license"])
    of_template = tpl.select("term", F.lit(1).cast("long").alias("n"), F.lit(0).alias("row"), F.lit(True).alias("fixed"))
    df = tf.select("term", "n", F.lit(1).alias("row"), F.lit(False).alias("fixed")).unionByName(of_template).groupBy("term").agg(F.sum("n").alias("df"), F.sum("row").alias("rows"), F.max("fixed").alias("fixed"))
    df = scratch.write(df)
    total = (pieces.agg(F.sum("n")).first()[0] or 0) + len(TEMPLATES)
    rows = df.agg(F.sum("rows")).first()[0] or 0
    often = F.col("fixed") | (F.col("rows") * share >= rows)
    idf = df.select("term", "fixed", (F.log(F.lit(float(total + 1)) / (F.col("df") + 1)) + 1).alias("idf"), often.alias("often"))
    frequent = F.broadcast(idf.filter("often").drop("often"))  # at most share + terms of TEMPLATES rows
    weight = F.col("tf") * F.col("idf")
    known = tf.join(frequent, "term").withColumn("w", weight)
    rare = tf.join(frequent, "term", "left_anti").join(idf.filter("not often"), "term").withColumn("w", weight)
    squares = known.select("pid", "w").unionByName(rare.select("pid", "w"))
    norm = squares.groupBy("pid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("pnorm"))
    by_tpl = tpl.join(frequent, "term").withColumn("w", weight).withColumn("tnorm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("tpl"))))
    sides = F.broadcast(by_tpl.select("term", "tpl", "license", (F.col("w") / F.col("tnorm")).alias("tw")))  # the terms of TEMPLATES
    dots = known.filter("fixed").join(sides, "term").groupBy("pid", "tpl", "license").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    scores = dots.join(norm, "pid").withColumn("score", F.round(F.col("dot") / F.col("pnorm"), 6)).filter(F.col("score") >= threshold)
    best = scores.groupBy("pid").agg(F.min(F.struct((-F.col("score")).alias("neg"), "license")).alias("b"))
    return best.select("pid", F.col("b.license").alias("license"), (-F.col("b.neg")).alias("score"))


def scan_licenses(files: DataFrame, path_col: str = "path", text_col: str = "text", id_col: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """One row per file: doc_id, path, own_license, own_score, license, inherited_from (directory, null if its own or none)."""
    scratch = Scratch(files.sparkSession)
    named = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    name = F.substring_index("path", "/", -1)
    directory = F.when(F.instr("path", "/") > 0, F.regexp_extract("path", "^(.*)/", 1)).when(F.col("path").isNotNull(), "")
    sentences = F.filter(F.split("text", r"\n|(?<=[.!?])[ \t]+"), lambda x: x.rlike(MENTION))
    is_file = F.coalesce(name.rlike(FILE_NAME), F.lit(False))
    pieces = F.when(F.col("text").rlike(MENTION), F.array_distinct(F.concat(sentences, F.when(is_file, F.array("text")).otherwise(F.array().cast("array<string>")))))
    rows = scratch.write(
        named.select("doc_id", "path", directory.alias("dir"), is_file.alias("is_file"), F.monotonically_increasing_id().alias("row"), F.coalesce(pieces, F.array().cast("array<string>")).alias("pieces"))
    )
    # pieces go by their md5: a whole licence file must not travel along with each of its terms
    held = rows.select("row", F.explode("pieces").alias("piece")).withColumn("pid", F.md5("piece"))
    distinct = scratch.write(held.groupBy("pid").agg(F.first("piece").alias("piece"), F.count(F.lit(1)).alias("n")))
    scored = scratch.write(scored_pieces(distinct, threshold, scratch=scratch))
    own = held.select("row", "pid").join(scored, "pid").groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("neg"), "license")).alias("b"))
    slim = rows.select("row", "doc_id", "path", "dir", "is_file")
    slim = scratch.write(slim.join(own, "row", "left").select("doc_id", "path", "dir", "is_file", F.col("b.license").alias("own_license"), (-F.col("b.neg")).alias("own_score")))

    givers = slim.filter(F.col("is_file") & F.col("own_license").isNotNull() & F.col("dir").isNotNull())
    givers = givers.groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("neg"), "own_license", "path")).alias("g")).select(F.col("dir").alias("at"), F.col("g.own_license").alias("given"))
    # each directory once, with itself and all ancestors: the deepest that has a licence file
    parts = F.split("dir", "/")
    dirs = slim.filter(F.col("dir").isNotNull()).select("dir").distinct()
    ups = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))
    nearest = (
        dirs.select("dir", F.posexplode(F.array_distinct(ups)).alias("depth", "at"))
        .join(givers, "at")
        .groupBy("dir")
        .agg(F.max(F.struct("depth", "at", "given")).alias("x"))
        .select(F.col("dir").alias("of"), "x.at", "x.given")
    )
    joined = slim.join(nearest, F.col("dir") == F.col("of"), "left")
    inherits = F.col("own_license").isNull()
    return joined.select(
        "doc_id", "path", "own_license", "own_score", F.coalesce("own_license", "given").alias("license"),
        F.when(inherits, F.col("at")).alias("inherited_from"),
    )
