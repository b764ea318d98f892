"""Licence scan by a positional index of rare licence words.

1. The templates are passages without blanks to fill in. A word's IDF counts the templates that hold it; a word in at most
   ``RARE_IN`` of them is indexed with every (template, position) it stands at.
2. A file's words that are in the index are looked up. Each posting says where the template would have to begin; postings of a
   template that agree on the beginning (within a few words, so that an edit does not split a passage) are counted together.
3. A template is found if the agreeing postings hold ``LEAST`` of its IDF and all its mandatory phrases stand in the file.

Beside this the phrases of ``BASE`` are found wherever they stand; their labels are always given.

Only DataFrame functions. A text is split once, where it is; what leaves it is the positions of licence words. The index is
as large as the templates, a fixed parameter, which is what bounds its broadcast.

Null and empty texts have no words: 0 places, null first and last word, empty labels, score 0. Very long texts are one array of
words of a row. Rows that repeat id and text are alike, each stays. Null ids are kept. Input columns other than doc_id and
text play no part. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import written

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RARE_IN = 3
LEAST = 0.6
#: Beginnings that differ by less than this share one of two overlapping buckets.
SPREAD = 4

# Phrases that are always labelled, and passages of public licences with their mandatory phrases.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = (
    ("mit", ("permission is hereby granted free of charge", "to deal in the software without restriction"),
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
     "the software to deal in the software without restriction including without limitation the rights to use copy modify merge "
     "publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"),
    ("mit", ("mit license",), "released under the mit license"),
    ("boost", ("any person or organization obtaining a copy",),
     "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying "
     "documentation covered by this license"),
    ("bsd", ("source and binary forms", "following conditions are met"),
     "redistribution and use in source and binary forms with or without modification are permitted provided that the following "
     "conditions are met"),
    ("isc", ("for any purpose with or without fee is hereby granted",),
     "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided "
     "that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", ("in no event will the authors be held liable",),
     "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any "
     "damages arising from the use of this software"),
    ("apache", ("except in compliance with the license",),
     "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you "
     "may obtain a copy of the license at"),
    ("gpl", ("gnu general public license", "free software foundation"),
     "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
     "published by the free software foundation"),
    ("lgpl", ("gnu lesser general public license", "free software foundation"),
     "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license "
     "as published by the free software foundation"),
    ("agpl", ("gnu affero general public license",),
     "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license "
     "as published by the free software foundation"),
    ("mpl", ("mozilla public license",),
     "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with "
     "this file you can obtain one at"),
    ("unlicense", ("free and unencumbered software released into the public domain",),
     "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or "
     "distribute this software"),
    ("cc0", ("waived all copyright and related or neighboring rights",), "waived all copyright and related or neighboring rights to this work"),
    ("cc-by", ("creative commons attribution 4 0",), "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", ("cc by 4 0",), "licensed under cc by 4 0"),
    ("cc-by-sa", ("cc by sa",), "licensed under cc by sa 4 0"),
    ("cc-by-nc", ("cc by nc",), "licensed under cc by nc 4 0"),
)


def index(templates=TEMPLATES, rare_in: int = RARE_IN) -> list[tuple[str, int, int, int]]:
    """(word, template, position, weight) of rare words; the weight is the word's IDF in thousandths, so that sums are exact."""
    words = [text.split() for _, _, text in templates]
    held = Counter(w for ws in words for w in set(ws))
    weight = lambda w: round(1000 * math.log((len(templates) + 1) / held[w]))
    return [(w, t, k, weight(w)) for t, ws in enumerate(words) for k, w in enumerate(ws) if held[w] <= rare_in]


def _phrases(templates) -> list[str]:
    return sorted({p for _, phrases, _ in templates for p in phrases})


def _rows(spark, rows: list[tuple], names: list[str]) -> DataFrame:
    listed = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])
    return spark.range(1).select(F.explode(listed).alias("r")).select("r.*")


def _stands(hits: Column, phrase: str) -> Column:
    """Starts of a phrase among the sorted hits (i, w): its words stand at consecutive places, so in consecutive hits."""
    words = phrase.split()

    def start(hit: Column, k: Column) -> Column:
        here = hit["w"] == words[0]
        for n, word in enumerate(words[1:], 1):
            later = F.get(hits, k + n)
            here = here & F.coalesce((later["w"] == word) & (later["i"] == hit["i"] + n), F.lit(False))
        return F.when(here, hit["i"])

    return F.array_compact(F.transform(hits, start))


def word_hits(docs: DataFrame, words: set[str], phrases: list[str]) -> DataFrame:
    """doc_id, key (of id and text), n_words, hits (i, w) of ``words`` in order, stand: which ``phrases`` the text holds."""
    text = F.coalesce("text", F.lit(""))
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.xxhash64(text).cast("string"), F.lit(":"), F.length(text).cast("string"))
    split = docs.select("doc_id", key.alias("key"), F.array_remove(F.split(F.translate(text, UPPER, LOWER), BREAK), "").alias("words"))
    hit = F.transform("words", lambda w, i: F.when(w.isin(*sorted(words)), F.struct(i.cast("long").alias("i"), w.alias("w"))))
    found = split.select("doc_id", "key", "words", F.array_compact(hit).alias("hits"))
    whole = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    joined = found.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), "hits", F.when(F.size("hits") > 0, whole).alias("whole"))
    stand = F.array_compact(F.array(*[F.when(F.contains("whole", F.lit(f" {p} ")), F.lit(p)) for p in phrases]))
    return joined.select("doc_id", "key", "n_words", "hits", F.when(F.col("whole").isNotNull(), stand).alias("stand"))


def scan(docs: DataFrame, templates=TEMPLATES, base: dict[str, str] = BASE, least: float = LEAST, rare_in: int = RARE_IN) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The score is 1 with a base label, else the largest share of a found template's IDF, else 0.
    """
    spark = docs.sparkSession
    postings = index(templates, rare_in)
    rare = sorted({p[0] for p in postings})
    wanted = set(rare) | {w for p in base for w in p.split()}
    rows = written(word_hits(docs, wanted, _phrases(templates)), "hits")

    mass = Counter()
    for _, t, _, weight in postings:
        mass[t] += weight
    named = [
        (word, t, label, at, weight, mass[t]) for word, t, at, weight in postings for label in (templates[t][0],)
    ]
    listed = F.broadcast(_rows(spark, named, ["w", "template", "label", "at", "weight", "mass"]))
    asked = F.create_map(*[F.lit(x) for t, (_, phrases, _) in enumerate(templates) for x in (t, ",".join(phrases))])
    places = (
        rows.select("key", "stand", F.explode(F.filter("hits", lambda h: h["w"].isin(*rare))).alias("h"))
        .select("key", "stand", F.col("h.w").alias("w"), F.col("h.i").alias("i")).join(listed, "w")
    )
    begin = F.col("i") - F.col("at")
    bucket = lambda phase: F.floor((begin + phase) / SPREAD) * 2 + (0 if phase == 0 else 1)
    agreed = (
        places.select("key", "stand", "template", "label", "at", "weight", "mass", F.explode(F.array(bucket(0), bucket(SPREAD // 2))).alias("begin"))
        .groupBy("key", "stand", "template", "label", "mass", "begin").agg(F.collect_set(F.struct("at", "weight")).alias("met"))
        .withColumn("share", F.aggregate("met", F.lit(0), lambda a, m: a + m["weight"]) / F.col("mass"))
        .groupBy("key", "stand", "template", "label").agg(F.max("share").alias("share"))
        .filter(F.col("share") >= least)
        .filter(F.size(F.array_except(F.split(asked[F.col("template")], ","), "stand")) == 0)
    )
    found = agreed.groupBy("key").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))

    starts = {phrase: _stands(F.col("hits"), phrase) for phrase in base}
    none = F.array().cast("array<string>")
    labelled = [F.when(F.size(starts[p]) > 0, F.array(F.lit(label))).otherwise(none) for p, label in base.items()]
    seen = rows.select(
        "doc_id", "key", "n_words", F.concat(*starts.values()).alias("starts"), F.array_sort(F.array_distinct(F.concat(*labelled))).alias("own"),
    )
    done = seen.join(found, "key", "left")
    labels = F.array_sort(F.array_union("own", F.coalesce("more", none)))
    return done.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").alias("first_word"),
        F.array_max("starts").alias("last_word"), F.array_join("own", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("starts") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def query(spark, folder: str) -> DataFrame:
    from lectern.llm.common import table

    return scan(table(spark, folder, "documents"))


def _sql() -> str:
    postings = ", ".join(f"('{w}', {t}, {k}, {weight}, '{TEMPLATES[t][0]}')" for w, t, k, weight in index())
    phrases = ", ".join(f"({t}, '{p}')" for t, (_, asked, _) in enumerate(TEMPLATES) for p in asked)
    base = ", ".join(f"('{p}', {len(p.split())}, '{label}')" for p, label in BASE.items())
    return rf"""
WITH t AS (SELECT * FROM (VALUES {postings}) v(w, template, pos, weight, label)),
m AS (SELECT template, sum(weight) AS mass FROM t GROUP BY template),
p AS (SELECT * FROM (VALUES {phrases}) v(template, phrase)),
b AS (SELECT * FROM (VALUES {base}) v(phrase, n, label)),
d AS (
    SELECT row_number() OVER () AS id, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
),
w AS (SELECT id, unnest(words) AS w, unnest(range(len(words))) AS i, words FROM d),
s AS (SELECT w.id, w.i, b.label FROM w JOIN b ON w.w = string_split(b.phrase, ' ')[1] AND array_to_string(w.words[w.i + 1 : w.i + b.n], ' ') = b.phrase),
o AS (SELECT id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM s GROUP BY id),
h AS (
    SELECT w.id, t.template, t.label, t.pos, t.weight, unnest([floor((w.i - t.pos) / {SPREAD}) * 2, floor((w.i - t.pos + {SPREAD // 2}) / {SPREAD}) * 2 + 1]) AS begin
    FROM w JOIN t ON w.w = t.w
),
g AS (
    SELECT id, template, label, begin, sum(weight) AS got FROM (SELECT DISTINCT * FROM h) GROUP BY id, template, label, begin
),
f AS (
    SELECT g.id, g.label, max(got / mass) AS share FROM g JOIN m ON g.template = m.template
    WHERE got / mass >= {LEAST} AND NOT EXISTS (
        SELECT 1 FROM p JOIN d ON d.id = g.id WHERE p.template = g.template AND NOT contains(' ' || array_to_string(d.words, ' ') || ' ', ' ' || p.phrase || ' ')
    )
    GROUP BY g.id, g.label
)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(o.n_base, 0) AS n_base, o.first_word, o.last_word,
    coalesce((SELECT string_agg(label, ',' ORDER BY label) FROM (SELECT DISTINCT label FROM s WHERE s.id = d.id)), '') AS base_labels,
    coalesce((SELECT string_agg(label, ',' ORDER BY label) FROM (SELECT label FROM s WHERE s.id = d.id UNION SELECT label FROM f WHERE f.id = d.id)), '') AS labels,
    CASE WHEN o.n_base > 0 THEN 1.0::DOUBLE ELSE coalesce((SELECT max(share) FROM f WHERE f.id = d.id), 0)::DOUBLE END AS score
FROM d LEFT JOIN o ON o.id = d.id
"""


SQL = _sql()
