"""License scans by diagonal voting, in built-in functions only.

Every two neighbouring words of a text are hashed and joined with the places
where license templates have them.  A hit votes for the diagonal: place in the
text less place in the template.  All words of a template at one place vote for
one diagonal; words put in or left out move the rest to a neighbouring one, so
diagonals close to each other are merged.  A span counts if enough of its
template's pairs were found in not too long a stretch; hits compare the words
themselves, so a collision of hashes never votes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The phrases of the contract, found word for word.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Names and notices of public licenses, as words.
TEMPLATES = (
    ("mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2.0"),
    ("mozilla public license", "mpl"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("bsd license", "bsd"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("lesser general public license", "lgpl"),
    ("affero general public license", "agpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("eclipse public license", "epl"),
    ("isc license", "isc"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nc", "cc-by-nc"),
    ("cc by nd", "cc-by-nd"),
    ("creative commons attribution", "cc-by"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("has waived all copyright and related or neighboring rights to", "cc0"),
)
# Two of these side by side say nothing about a license and are no votes.
FUNCTION_WORDS = frozenset("a all and any as at by can for in into is it may not of or that the this to under with without you".split())
# Diagonals at most so far apart are one span.
NEAR = 3
# Share of a template's pairs that its span must hold, and its length in that of the template.
COVERED_PERCENT = 75
STRETCH = 2


def template_pairs() -> list[tuple]:
    """(template, label, base, words, pairs, nth, x, y) of each pair of neighbouring words that votes.

    At most 63 pairs vote for a template: a span keeps them as the bits of a number.
    """
    rows = []
    for number, (text, label, base) in enumerate([*[(*b, True) for b in BASE], *[(*t, False) for t in TEMPLATES]]):
        words = text.split()
        pairs = [(i, x, y) for i, (x, y) in enumerate(zip(words, words[1:])) if base or not (x in FUNCTION_WORDS and y in FUNCTION_WORDS)]
        rows += [(number, label, base, len(words), len(pairs), i, x, y) for i, x, y in pairs]
    return rows


def _values(rows: list[tuple]) -> str:
    def sql(v):
        return str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(sql(v) for v in row) + ")" for row in rows)


COLUMNS = "template, label, base, words, pairs, nth, x, y"


def _templates(spark: SparkSession) -> DataFrame:
    """The pairs with their hashes, and the mark that each text carries."""
    pairs = f"SELECT xxhash64(x, y) AS h, {COLUMNS} FROM VALUES {_values(template_pairs())} AS t({COLUMNS})"
    return spark.sql(f"{pairs} UNION ALL SELECT 0L, -1, NULL, false, 0, 1, 0, NULL, NULL")


def license_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (row, key, n_words, template, label, base, start, end, covered, places).

    One for each span of a template in a text, places being those where a base
    phrase stands in it whole, and one with template -1 for the text itself.
    """
    words = F.regexp_extract_all(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, UPPER.lower()), F.lit(WORD), F.lit(0))
    # the mark comes first, a pair without a first word, so that a text without hits keeps a row
    before = F.concat(F.array(F.lit(None).cast("string")), words)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), before.alias("x"))
    rows = rows.select("row", "key", "x", F.slice("x", F.lit(2), F.size("x")).alias("y"))
    # the words stay behind: each pair would carry a copy of all of them
    rows = rows.select("row", "key", F.size("y").cast("long").alias("n_words"), F.arrays_zip("x", "y").alias("pairs"))
    pairs = rows.select("row", "key", "n_words", F.posexplode("pairs").alias("pos", "g"))
    h = F.when(F.col("g.x").isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64("g.x", "g.y"))
    pairs = pairs.select("row", "key", "n_words", (F.col("pos") - 1).alias("pos"), F.col("g.x").alias("gx"), F.col("g.y").alias("gy"), h.alias("h"))
    # as many rows as the templates above have pairs
    hits = pairs.join(F.broadcast(_templates(docs.sparkSession)), "h").filter("gx = x AND gy = y OR gx IS NULL AND x IS NULL")
    text_of, template = ["row", "key", "n_words"], ["template", "label", "base", "words", "pairs"]
    # a place of the template votes once for a diagonal, so the sum of bits is their union
    votes = hits.groupBy(*text_of, *template, (F.col("pos") - F.col("nth")).alias("diagonal")).agg(
        F.sum(F.expr("shiftleft(1L, nth)")).alias("bits"), F.min("pos").alias("start"), F.max("pos").alias("last")
    )
    along = W.partitionBy("row", "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > NEAR, F.lit(True))
    votes = votes.withColumn("far", far.cast("int"))
    votes = votes.withColumn("span", F.sum("far").over(along.rowsBetween(W.unboundedPreceding, 0)))
    whole = F.col("base") & (F.bit_count("bits") == F.col("pairs"))
    spans = votes.groupBy(*text_of, *template, "span").agg(
        F.bit_count(F.bit_or("bits")).alias("covered"), F.min("start").alias("start"), (F.max("last") + 2).alias("end"),
        F.sum(whole.cast("long")).alias("n_places"), F.min(F.when(whole, F.col("start"))).alias("first_place"), F.max(F.when(whole, F.col("start"))).alias("last_place"),
    )
    found = F.when(F.col("base"), F.col("n_places") > 0).otherwise(
        (F.col("template") < 0)
        | (F.col("covered") * 100 >= F.col("pairs") * COVERED_PERCENT) & (F.col("end") - F.col("start") <= F.col("words") * STRETCH)
    )
    share = F.when(F.col("template") < 0, F.lit(0.0)).when(F.col("base"), F.lit(1.0)).otherwise(F.col("covered") / F.col("pairs"))
    return spans.filter(found).withColumn("share", share).withColumnRenamed("key", key)


def license_labels(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``key``, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A-Z are lower-cased; words are runs of ASCII letters, digits and all
    characters beyond ASCII.  n_base counts the places of the base phrases,
    first_word and last_word are the smallest and largest word at which one
    starts (null without any).  labels holds those of other templates, too;
    both are different labels in order, joined by commas.  score is 1 with a
    base phrase, else the largest share of a template's pairs in a span, 0
    without one.  Null and empty texts have no words; repeated rows and null
    keys get a row each; other columns are not looked at; no rows give no rows.
    """
    spans = license_spans(docs, key, text)
    name = f"`{key.replace('`', '``')}`"
    rows = spans.groupBy("row", F.col(name).alias("key"), "n_words").agg(
        F.sum("n_places").alias("n_base"),
        F.min("first_place").cast("long").alias("first_word"), F.max("last_place").cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set("label")).alias("labels"), F.max("share").alias("score"),
    )
    return rows.select(
        F.col("key").alias(key), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


ORACLE = rf"""WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}') AS w FROM documents),
t({COLUMNS}) AS (VALUES {_values(template_pairs())}),
g AS (SELECT row, i - 1 AS pos, w[i] AS x, w[i + 1] AS y FROM (SELECT row, w, unnest(range(1, len(w))) AS i FROM d)),
v AS (SELECT row, template, label, base, words, pairs, pos - nth AS diagonal, list(nth) AS ats, min(pos) AS b, max(pos) AS e FROM g JOIN t USING (x, y) GROUP BY ALL),
place AS (SELECT row, label, diagonal AS place_at FROM v WHERE base AND len(ats) = pairs),
marked AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY row, template ORDER BY diagonal) <= {NEAR} THEN 0 ELSE 1 END AS far FROM v WHERE NOT base),
numbered AS (SELECT *, sum(far) OVER (PARTITION BY row, template ORDER BY diagonal) AS span FROM marked),
other AS (SELECT row, label, len(list_distinct(flatten(list(ats)))) / any_value(pairs) AS share FROM numbered GROUP BY row, template, label, span
 HAVING len(list_distinct(flatten(list(ats)))) * 100 >= any_value(pairs) * {COVERED_PERCENT} AND max(e) + 2 - min(b) <= any_value(words) * {STRETCH}),
labelled AS (SELECT row, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(share) AS share
 FROM (SELECT row, label, share FROM other UNION ALL SELECT row, label, 1.0 FROM place) GROUP BY row),
based AS (SELECT row, count(*) AS n, min(place_at) AS first_word, max(place_at) AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM place GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
 coalesce(labels, '') AS labels, coalesce(share, 0)::DOUBLE AS score FROM d LEFT JOIN labelled USING (row) LEFT JOIN based USING (row)"""
