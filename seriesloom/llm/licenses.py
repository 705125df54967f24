"""Licence scan: TF-IDF cosine to templates, then nearest-ancestor inheritance (operator 3, DataFrame functions only).

What is compared with the templates are a file's sections: each line that holds a licence word (``MARKS``), each paragraph
(run of lines that are not blank) around such lines, from its first to its last line, and of a licence file, besides, its
whole text. A section's words weigh ``1 + ln(tf)`` times the inverse document frequency of the templates (add-one smoothed),
words of no template likewise with a frequency of 0, so foreign words lengthen the section and lower its cosine; the cosine
with each template is a join of words and a sum. A file declares the licence of the template that is nearest to any of its
sections, if the cosine reaches ``threshold``.

A licence file (by its name, or because a given column says so) declares for its directory. Every other file without a
licence of its own takes that of its nearest ancestor directory that has one: files are joined with declarations on each
ancestor path, and the deepest match wins.

Plan: texts of no licence word end at one regular expression, licence files or not (without such a word no template is near:
each template has one). Words of sections are counted per file before any shuffle. Templates are a fixed list (some hundred
words), broadcast. Ancestors are at most the depth of the path; a directory has one declaration after aggregation, so the
path join cannot multiply, and a directory that holds a third of all files is split by the skew join or met by broadcast
if declarations are few (counted first).

Defined results: null or wordless text declares nothing; very long texts are read whole, and a section may be the whole of
one; a null path is the root's own file; ties of cosine go to the alphabetically first licence, ties of declarations in a
directory to the larger cosine, then the first licence; repeated rows are kept; an empty table gives an empty result; further
columns of any name are ignored or, by :func:`scan`, passed through.
"""

from __future__ import annotations

import math
import string
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, hinted

MARKS = r"(?i)licen[cs]e|copyright|permission is hereby|warrant(?:y|ies)|redistribution|spdx-|released under|public domain"
#: Header phrases of common licences (public texts, shortened to their telling sentences).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE-2.0",
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software. The above copyright notice and this permission notice shall be included in all copies",
    "MIT-short": "Released under the MIT License.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "BSD-short": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file. All rights reserved.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or any later version",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http mozilla org MPL 2.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
}
WORD_SPLIT = r"[^a-z0-9.]+"
#: What parts paragraphs: a line feed and one or more lines of blanks.
PARAGRAPHS = r"\n(?:[ \t\r]*\n)+"
THRESHOLD = 0.55
BROADCAST_ROWS = 500_000


def _words(text: str) -> list[str]:
    import re

    return [w for w in (x.strip(".") for x in re.split(WORD_SPLIT, text.lower())) if w]


def template_weights() -> list[tuple[str, str, float]]:
    """(licence, word, weight): unit vectors; names lose their ``-short``."""
    counts = {name: Counter(_words(text)) for name, text in TEMPLATES.items()}
    df = Counter(w for c in counts.values() for w in c)
    idf = {w: math.log((1 + len(counts)) / (1 + n)) + 1 for w, n in df.items()}
    out = []
    for name, c in counts.items():
        weights = {w: (1 + math.log(n)) * idf[w] for w, n in c.items()}
        norm = math.sqrt(sum(x * x for x in weights.values()))
        out += [(name, w, idf[w], x / norm) for w, x in weights.items()]
    return out


def unknown_weight() -> float:
    """Inverse document frequency of a word that no template has."""
    return math.log(1 + len(TEMPLATES)) + 1


def sections(text: Column, whole: Column) -> Column:
    """The distinct sections of a text: marked lines, marked paragraphs, and the text itself where ``whole`` is true."""
    marked = lambda parts: F.filter(parts, lambda x: F.regexp_like(x, F.lit(MARKS)))
    own = F.when(whole, F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(marked(F.split(text, "\n", -1)), marked(F.split(text, PARAGRAPHS, -1)), own))


def declared(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(key, licence, cosine) of rows (key, text, whole) of which a section is near a template. Rows of equal key are equal."""
    spark = files.sparkSession
    templates = F.broadcast(spark.createDataFrame(template_weights(), "template string, word string, idf double, weight double"))
    marked = files.where(F.regexp_like("text", F.lit(MARKS))).dropDuplicates(["key"])
    parts = marked.select("key", F.posexplode(sections(F.col("text"), F.col("whole"))).alias("section", "text"))
    tokens = parts.select("key", "section", F.explode(F.split(F.translate("text", string.ascii_uppercase, string.ascii_lowercase), WORD_SPLIT, -1)).alias("word"))
    tokens = tokens.select("key", "section", F.btrim("word", F.lit(".")).alias("word")).where("word <> ''")
    counted = tokens.groupBy("key", "section", "word").agg(F.count("*").alias("tf"))
    idf = F.broadcast(spark.createDataFrame(sorted({(w, i) for _, w, i, _ in template_weights()}), "word string, idf double"))
    weighed = counted.join(idf, "word", "left").select("key", "section", "word", F.col("idf").isNotNull().alias("known"), ((1 + F.log("tf")) * F.coalesce("idf", F.lit(unknown_weight()))).alias("x"))
    norms = weighed.groupBy("key", "section").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighed.where("known").join(templates, "word").groupBy("key", "section", "template").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    near = dots.join(norms, ["key", "section"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 6)).withColumn("licence", F.regexp_replace("template", "-short$", ""))
    best = near.groupBy("key").agg(F.min(F.struct((-F.col("cosine")).alias("far"), "licence")).alias("b"))
    return best.select("key", F.col("b.licence").alias("licence"), (-F.col("b.far")).alias("cosine")).where(F.col("cosine") >= threshold)


def ancestors(path: Column) -> Column:
    """The directories above a path, the root (empty string) included; at most its depth."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def scan(files: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (key, path, text, is_licence_file, ...) without text, with licence, how (``own``, ``inherited`` or null), cosine
    and from_dir, the directory whose declaration was inherited. Rows of equal key must be equal."""
    own = cut(declared(files.select("key", "text", F.coalesce("is_licence_file", F.lit(False)).alias("whole")), threshold), "licences")
    names = files.drop("text").withColumns({"path": F.coalesce("path", F.lit("")), "is_licence_file": F.coalesce("is_licence_file", F.lit(False))})
    known = names.join(own, "key", "left")
    directory = F.regexp_replace("path", "/?[^/]*$", "")
    per_dir = known.where(F.col("is_licence_file") & F.col("licence").isNotNull()).select(directory.alias("dir"), "licence", "cosine")
    per_dir = per_dir.groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("far"), "licence")).alias("b"))
    per_dir = cut(per_dir.select("dir", F.col("b.licence").alias("given")), "declarations")
    dirs = known.where("licence is null").select(directory.alias("file_dir")).distinct()  # directories, not files, look upwards
    up = dirs.select("file_dir", F.explode(ancestors(F.concat("file_dir", F.lit("/x")))).alias("dir"))
    nearest = up.join(hinted(per_dir, BROADCAST_ROWS), "dir").groupBy("file_dir").agg(F.max(F.struct(F.length("dir").alias("depth"), "dir", "given")).alias("b"))
    nearest = cut(nearest.select("file_dir", F.col("b.given").alias("given"), F.col("b.dir").alias("from_dir")), "nearest")
    out = known.withColumn("file_dir", F.when(F.col("licence").isNull(), directory)).join(hinted(nearest, BROADCAST_ROWS), "file_dir", "left")
    how = F.when(F.col("licence").isNotNull(), F.lit("own")).when(F.col("given").isNotNull(), F.lit("inherited"))
    return out.select(*names.columns, F.coalesce("licence", "given").alias("licence"), how.alias("how"), "cosine", "from_dir")


def files_of(docs: DataFrame) -> DataFrame:
    """Documents as files of repositories: source/lang/thousands/hundreds/number.

    A document whose number is a multiple of 10 stands for a licence file: of the source if it is a multiple of 500, of the
    language's directory if of 100, of the thousands' if of 50, else of its own. The key is the identifier and the hash of
    the rest.
    """
    number = F.coalesce(F.col("doc_id"), F.lit(-1))
    up = lambda n: F.pmod(number, F.lit(n)) == 0
    folders = [F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.floor(number / 1000).cast("string"), F.floor(number / 100).cast("string")]
    depth = F.when(up(500), 1).when(up(100), 2).when(up(50), 3).otherwise(4)
    path = F.concat_ws("/", F.array_join(F.slice(F.array(*folders), F.lit(1), depth), "/"), number)
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.xxhash64("text", "source", "lang"))
    return docs.select(key.alias("key"), "doc_id", path.alias("path"), "text", up(10).alias("is_licence_file"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, licence, how, cosine, from_dir of every document."""
    return scan(files_of(docs)).select("doc_id", "licence", "how", "cosine", "from_dir")


def sql() -> str:
    """DuckDB: the same over ``documents``."""
    text = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)
    rows = ", ".join("(" + ", ".join(map(text, r)) + ")" for r in template_weights())
    return rf"""
with t(template, word, idf, weight) as (values {rows}),
idf as (select distinct word, idf from t),
f as (select doc_id, text, doc_id % 10 = 0 as is_file,
  array_to_string([source, lang, (doc_id // 1000)::varchar, (doc_id // 100)::varchar][1 : case when doc_id % 500 = 0 then 1 when doc_id % 100 = 0 then 2 when doc_id % 50 = 0 then 3 else 4 end], '/') as dir from documents),
m as (select distinct doc_id, unnest(list_concat(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{MARKS}')), list_filter(regexp_split_to_array(text, '{PARAGRAPHS}'), lambda x: regexp_matches(x, '{MARKS}')), case when is_file then [text] else [] end)) as txt
  from f where regexp_matches(text, '{MARKS}')),
k as (select doc_id, row_number() over () as section, translate(txt, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as txt from m),
c as (select doc_id, section, word, count(*) as tf from (select doc_id, section, trim(unnest(regexp_split_to_array(txt, '[^a-z0-9.]+')), '.') as word from k) where word <> '' group by all),
x as (select doc_id, section, word, (1 + ln(tf)) * coalesce(idf, {unknown_weight()!r}) as x from c left join idf using (word)),
n as (select section, sqrt(sum(x * x)) as norm from x group by section),
d as (select doc_id, section, template, sum(x * weight) as dot from x join t using (word) group by all),
s as (select doc_id, round(dot / norm, 6) as cosine, regexp_replace(template, '-short$', '') as licence from d join n using (section)),
own as (select * from s qualify row_number() over (partition by doc_id order by cosine desc, licence) = 1),
known as (select f.doc_id, f.dir, f.is_file, own.licence, own.cosine from f left join own on own.doc_id = f.doc_id and own.cosine >= {THRESHOLD}),
decl as (select dir, licence as given from known where is_file and licence is not null qualify row_number() over (partition by dir order by cosine desc, licence) = 1),
near as (select k.doc_id, max_by(decl.given, len(decl.dir)) as given, max_by(decl.dir, len(decl.dir)) as from_dir from known k join decl on starts_with(k.dir || '/', decl.dir || '/') where k.licence is null group by k.doc_id)
select known.doc_id, coalesce(licence, given) as licence, case when licence is not null then 'own' when given is not null then 'inherited' end as how, cosine, from_dir
from known left join near using (doc_id)
"""
