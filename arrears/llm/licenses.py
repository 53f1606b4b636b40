"""License scans by an exact set-similarity join (DataFrame functions only).

A template is the word set of a license notice. Text blocks are windows of
words, whatever the line breaks: a notice of at most c words is compared with
windows of 2 * c words that start at every c-th word, so that it stands whole
in one of them wherever it is; c is the least of ``SCALES`` that fits. A block
meets a template when it holds at least ``num / den`` of the template's words
(containment) and all of the words that name the license, so that a notice of
another license or version is not taken for it. Words are lower-cased runs of
ASCII digits, letters and anything beyond ASCII.

Only windows around naming words can meet a template, and only they are made.

The join orders tokens by their frequency over the whole corpus, rarest first
(equal counts by the word). Only words of some template matter. A template of
size t must share ``need = ceil(t * num / den)`` words, so the block holds one
of its ``t - need + 1`` rarest words (prefix filter), has at least ``need``
template words at all (length filter), and, from the first common word on, both
sides still have ``need`` words left (positional filter). What passes is
counted exactly. Templates are fixed data, a few hundred words in all, and are
sent along as literals.

Base labels are phrases: places where a phrase's words stand consecutively,
over all words of the text. The method adds labels; base labels stay.

Defined results: a null text is empty; a text without words has no places and
no labels, score 0. Several blocks or templates of one label count once. The
score is 1 for a base label, else the largest containment found. Repeated rows
are rows of their own.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arrears.llm.store import Scratch

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# fixed values: phrases of the contract and their labels
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# fixed values: license notices, as (label, notice, naming words)
TEMPLATES = (
    ("mit", "Released under the MIT License", "under mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "hereby granted person"),
    ("apache-2", "Licensed under the Apache License, Version 2.0", "apache 2"),
    ("gpl-2", "under the terms of the GNU General Public License, version 2", "general public 2"),
    ("gpl-2", "either version 2 of the License, or (at your option) any later version", "option 2"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3", "general public 3"),
    ("gpl-3", "either version 3 of the License, or (at your option) any later version", "option 3"),
    ("agpl-3", "under the terms of the GNU Affero General Public License, version 3", "affero"),
    ("lgpl", "under the terms of the GNU Lesser General Public License", "lesser"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial license", "creative commons noncommercial"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike license", "creative commons sharealike"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", "redistribution forms"),
    ("bsd", "Released under the BSD License", "under bsd license"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "purpose fee hereby"),
    ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered"),
    ("reserved", "All rights reserved", "reserved"),
    ("mpl-2", "subject to the terms of the Mozilla Public License, v. 2.0", "mozilla"),
)
SCALES = (4, 8, 16, 32)       # words of a notice at most
NUM, DEN = 8, 10


def template_sets(templates=TEMPLATES) -> list[tuple[int, str, list[str], list[str], int]]:
    """(number, label, words, naming words, scale) of every template."""
    out = []
    for i, (label, text, names) in enumerate(templates):
        words = re.findall(WORD, text.lower())
        out.append((i, label, sorted(set(words)), names.split(), next(c for c in SCALES if c >= len(words))))
    return out


def need(size: int, num: int = NUM, den: int = DEN) -> int:
    return -(-size * num // den)


def lowered(text: str = "text") -> Column:
    return F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), UPPER, LOWER)


def _words(low: Column) -> Column:
    return F.array_remove(F.split(low, NOT_WORD + "+"), "")


def template_words(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, _, words, _, _ in template_sets(templates) for w in words})


def blocks_of(named: str, words: str, templates=TEMPLATES) -> Column:
    """Of ``words`` the blocks (scale, tokens) around the naming words, which
    stand at ``named``, with their distinct template words."""
    known = F.array(*[F.lit(w) for w in template_words(templates)])

    def at(scale):
        starts = F.array_distinct(F.flatten(F.transform(named, lambda p: F.array(
            (p - p % scale).cast("int"), F.greatest(F.lit(0), p - p % scale - scale).cast("int")))))
        return F.transform(starts, lambda i: F.struct(
            F.lit(scale).alias("scale"), F.array_intersect(F.slice(words, i + 1, 2 * scale), known).alias("tokens")))
    return F.concat(*[at(c) for c in sorted({x[4] for x in template_sets(templates)})])


def names_at(words: str, templates=TEMPLATES) -> Column:
    """Places of naming words."""
    names = sorted({w for _, _, _, names, _ in template_sets(templates) for w in names})
    return F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(*names), i)))


def block_matches(s: Scratch, blocks: DataFrame, templates=TEMPLATES, num: int = NUM, den: int = DEN) -> DataFrame:
    """``blocks`` (row, blocks) -> (row, label, containment) of every block that meets a template."""
    sets = template_sets(templates)
    least = min(need(len(words), num, den) for _, _, words, _, _ in sets)
    blocks = blocks.select("row", F.inline("blocks"))
    # frequencies over all blocks of the corpus: one row per template word
    counted = s.write(blocks.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")), "frequency")
    vocabulary = template_words(templates)
    order = s.spark.createDataFrame([(w,) for w in vocabulary], "token string").join(counted, "token", "left").select(
        "token", F.row_number().over(Window.orderBy(F.coalesce("n", F.lit(0)), "token")).alias("rank"))
    ranks = {r["token"]: r["rank"] for r in order.collect()}          # as many rows as the templates have words
    # ranks by word, found by a word's place in the vocabulary
    known, by_place = F.array(*[F.lit(w) for w in vocabulary]), F.array(*[F.lit(ranks[w]) for w in vocabulary])
    ranked = blocks.where(F.size("tokens") >= least).select("row", "scale", F.array_sort(F.transform(
        "tokens", lambda w: F.get(by_place, F.array_position(known, w).cast("int") - 1))).alias("ranks"))
    prefixes = []
    for i, label, words, names, scale in sets:
        mine = sorted(ranks[w] for w in words)
        n = need(len(words), num, den)
        for at in range(len(words) - n + 1):
            prefixes.append((mine[at], scale, i, label, at, len(mine), n, mine, [ranks[w] for w in names]))
    prefixes = s.spark.createDataFrame(prefixes, "rank int, scale int, template int, label string, t_at int, t_size int, need int, t_ranks array<int>, names array<int>")
    probe = ranked.select("row", "scale", "ranks", F.posexplode("ranks").alias("b_at", "rank"))
    left = F.least(F.col("t_size") - F.col("t_at"), F.size("ranks") - F.col("b_at"))
    found = probe.join(F.broadcast(prefixes), ["rank", "scale"]).where((F.size("ranks") >= F.col("need")) & (left >= F.col("need")))
    shared = F.size(F.array_intersect("ranks", "t_ranks"))
    found = found.where((shared >= F.col("need")) & (F.size(F.array_except("names", "ranks")) == 0))
    return found.groupBy("row", "label").agg(F.max(shared / F.col("t_size")).alias("containment"))


def _places(words: Column, phrase: str) -> Column:
    """Starts of a phrase in an array of words."""
    parts = phrase.split()
    last = F.size(words) - len(parts)
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))

    def here(i):
        ok = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            ok = ok & (F.get(words, i + k) == p)
        return ok
    return F.filter(starts, here)


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score."""
    s = Scratch(spark, "licenses")
    # rows of one id are told apart by their text
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    # the only pass over the texts: counts, phrase places and blocks
    rows = rows.select("doc_id", "row", _words(lowered()).alias("words")).withColumn("named", names_at("words"))
    rows = rows.select("doc_id", "row", "words", blocks_of("named", "words").alias("blocks"))
    may = F.lit(False)
    for phrase in PHRASES:
        one = F.lit(True)
        for w in set(phrase.split()):
            one = one & F.array_contains("words", w)
        may = may | one
    none = F.array().cast("array<int>")
    base = s.write(rows.select("doc_id", "row", "blocks", F.size("words").cast("long").alias("n_words"),
                               *[F.when(may, _places(F.col("words"), p)).otherwise(none).alias(f"p{i}") for i, p in enumerate(PHRASES)]), "rows")
    found = block_matches(s, base.select("row", "blocks"))
    found = s.write(found.groupBy("row").agg(F.array_sort(F.collect_set("label")).alias("more"), F.max("containment").alias("top")), "matches")
    places = F.concat(*[F.col(f"p{i}") for i in range(len(PHRASES))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())]))
    base = base.select("doc_id", "row", "n_words", places.alias("places"), labels.alias("own"))
    out = base.join(found, "row", "left")
    return out.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places").cast("long").alias("first_word"),
        F.array_max("places").cast("long").alias("last_word"), F.array_join(F.array_sort(F.array_distinct("own")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("own", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("top", F.lit(0.0))).alias("score"))


def _oracle() -> str:
    # every window of every scale, and every template of that scale: no naming words looked for first, no prefixes
    rows = []
    for label, text, names in TEMPLATES:
        words = re.findall(WORD, text.lower())
        scale = 4
        while scale < len(words):
            scale *= 2
        rows.append(f"('{label}', {scale}, {sorted(set(words))}, {names.split()})")
    sets = ", ".join(rows)
    places = []
    for p in PHRASES:
        parts = p.split()
        test = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(parts, 1))
        places.append(f"[i FOR i IN range(0, len(w)) IF {test}]")
    cols = ", ".join(f"{x} AS p{i}" for i, x in enumerate(places))
    own = ", ".join(f"CASE WHEN len(p{i}) > 0 THEN '{label}' END" for i, label in enumerate(PHRASES.values()))
    every = " || ".join(f"p{i}" for i in range(len(PHRASES)))
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
w AS (SELECT *, regexp_extract_all(low, '{WORD}') AS w FROM d),
p AS (SELECT r, doc_id, len(w) AS n_words, {cols} FROM w),
q AS (SELECT *, {every} AS places, [x FOR x IN [{own}] IF x IS NOT NULL] AS own FROM p),
t(label, scale, words, names) AS (VALUES {sets}),
i AS (SELECT r, w, scale, unnest(range(0, len(w), scale)) AS pos FROM w, (SELECT DISTINCT scale FROM t)),
b AS (SELECT r, scale, w[pos + 1 : pos + 2 * scale] AS bw FROM i),
m AS (SELECT r, label, len(list_intersect(bw, words)) AS shared, len(words) AS size FROM b JOIN t USING (scale) WHERE list_has_all(bw, names)),
f AS (SELECT r, list(DISTINCT label) AS more, max(shared / size) AS top FROM m WHERE shared * {DEN} >= size * {NUM} GROUP BY r)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base, CAST(list_min(places) AS BIGINT) AS first_word,
  CAST(list_max(places) AS BIGINT) AS last_word, array_to_string(list_sort(list_distinct(own)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(own || coalesce(more, []))), ',') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(top, 0.0)::DOUBLE END AS score
FROM q LEFT JOIN f USING (r)
"""


ORACLE_SQL = _oracle()
