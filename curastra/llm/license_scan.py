"""Licence scan: an exact set-similarity join of text blocks with licence templates.

A template's words are put in a global order, rarest in the corpus first. A block contains
a template if it has at least ``ceil(threshold * words)`` of its words; then it has one of
the first ``words - needed + 1``, the template's prefix. Documents without any prefix word
are skipped; for the others each line is a block, reduced to words of the templates (length
filter), and a template is only compared if its first shared prefix word leaves enough words
behind it on either side (positional filter). A notice may be wrapped, so every run of as many
words as a template has is a block for it too, across line ends; only runs around the template's
prefix words are looked at.

DataFrame functions only, no shuffle of texts: all templates together are a literal of the
plan, whose size doesn't depend on the corpus. The word order comes from one pass that
counts the documents with each template word; that result has a row for each such word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .url_filter import LOWER, UPPER

#: What isn't part of a word.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases that are looked for word by word.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Notices of well-known licences.
TEMPLATES = {
    "mit-notice": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "apache-2-notice": "licensed under the apache license version 2 0",
    "bsd-conditions": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-grant": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "mpl-2-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-sa-notice": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "all-rights-reserved": "copyright all rights reserved",
}


def needed(words: int, threshold: float) -> int:
    return math.ceil(round(threshold * words, 9))


def _lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def word_order(docs: DataFrame, templates: dict[str, str], text_col: str = "text") -> list[str]:
    """The templates' words, those in the fewest documents first (then by the word)."""
    known = sorted({w for t in templates.values() for w in t.split()})
    held = F.array_intersect(F.split(F.regexp_replace(_lowered(docs[text_col]), BETWEEN, " "), " "), F.array(*map(F.lit, known)))
    counted = {r.w: r.n for r in docs.select(F.explode(held).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    return sorted(known, key=lambda w: (counted.get(w, 0), w))


def scan_licenses(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8, text_col: str = "text") -> DataFrame:
    """Adds to each document what licences it names.

    ``n_words``; ``n_base``, ``first_word``, ``last_word`` of the places where a phrase's
    words stand consecutively (words count from 0; null without any); ``base_labels``;
    ``labels`` (base labels and those of templates that a line, or as many consecutive words
    as the template has, contain to ``threshold``);
    ``score``: 1 with a base label, else the best containment at the threshold or above, else
    0. Labels are distinct, sorted and joined by commas. Words are runs of a-z, 0-9 and
    characters from U+0080 on, after A-Z are lower-cased. A null or empty text has no words
    and no labels. Input columns with these names are replaced; repeated rows each get a row.
    """
    new = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    others = [c for c in docs.columns if c not in new]
    order = word_order(docs, templates, text_col)
    rank = {w: i for i, w in enumerate(order)}
    sized = []
    for label, text in templates.items():
        ranks = sorted(rank[w] for w in set(text.split()))
        need = needed(len(ranks), threshold)
        sized.append((label, ranks, need, ranks[: len(ranks) - need + 1]))
    first_words = sorted({order[r] for t in sized for r in t[3]})
    least = min((t[2] for t in sized), default=1)

    def ints(values):
        return F.array(*(F.lit(v) for v in values))

    known = F.array(*map(F.lit, order))
    index = F.array(*(F.struct(F.lit(a).alias("label"), ints(r).alias("ranks"), F.lit(n).alias("need"), ints(p).alias("prefix")) for a, r, n, p in sized))

    def contained(block: Column):
        """Structs (label, share) of the templates in a block of ranks."""

        def fits(t: Column) -> Column:
            x = F.array_min(F.array_intersect(block, t["prefix"]))
            room = F.least(F.size(t["ranks"]) - F.array_position(t["ranks"], x), F.size(block) - F.array_position(block, x))
            return x.isNotNull() & (room + 1 >= t["need"]) & (F.size(F.array_intersect(block, t["ranks"])) >= t["need"])

        share = lambda t: F.size(F.array_intersect(block, t["ranks"])) / F.size(t["ranks"])
        return F.transform(F.filter(index, fits), lambda t: F.struct(t["label"].alias("label"), share(t).alias("share")))

    own = F.array(*(F.struct(F.lit(a).alias("label"), F.array(*map(F.lit, sorted(set(templates[a].split())))).alias("words"), F.array(*(F.lit(order[r]) for r in p)).alias("prefix"), F.lit(n).alias("need"), F.lit(len(templates[a].split())).alias("length")) for a, _, n, p in sized))

    def wrapped(words: Column):
        """Structs (label, share) of the templates in runs of words, whatever lines these are on."""
        hits = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: F.array_contains(F.array(*map(F.lit, first_words)), h["w"]))

        def around(h: Column, t: Column) -> Column:
            return F.slice(words, F.greatest(h["i"] - t["length"] + 2, F.lit(1)), 2 * t["length"] - 1)

        def most(h: Column, t: Column) -> Column:
            near = around(h, t)
            starts = F.sequence(F.lit(1), F.greatest(F.size(near) - t["length"] + 1, F.lit(1)))
            return F.array_max(F.transform(starts, lambda k: F.size(F.array_intersect(F.slice(near, k, t["length"]), t["words"]))))

        def found(h: Column) -> Column:
            close = F.filter(own, lambda t: F.array_contains(t["prefix"], h["w"]) & (F.size(F.array_intersect(around(h, t), t["words"])) >= t["need"]))
            held = F.transform(close, lambda t: F.struct(t["label"].alias("label"), most(h, t).alias("n"), t["need"].alias("need"), F.size(t["words"]).alias("of")))
            return F.transform(F.filter(held, lambda m: m["n"] >= m["need"]), lambda m: F.struct(m["label"].alias("label"), (m["n"] / m["of"]).alias("share")))

        return F.flatten(F.transform(hits, found))

    rows = docs.select(*(docs[c] for c in others), _lowered(docs[text_col]).alias("_low"))
    rows = rows.withColumn("_words", F.split(F.trim(F.regexp_replace("_low", BETWEEN, " ")), " "))
    rows = rows.withColumn("_line", F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" ")))

    places, first, last, base = [], [], [], []
    line = F.col("_line")
    before = lambda at: at - 1 - F.length(F.replace(F.substring(line, F.lit(1), at - 1), F.lit(" "), F.lit("")))
    for phrase, label in phrases.items():
        whole = f" {phrase} "
        has = line.contains(whole)
        places.append(F.when(has, F.regexp_count(line, F.lit(f"(?={whole})"))).otherwise(0))
        first.append(F.when(has, before(F.instr(line, whole))))
        end = F.length(line) - F.instr(F.reverse(line), whole[::-1]) - len(whole) + 2
        last.append(F.when(has, before(end)))
        base.append(F.when(has, F.lit(label)))
    one = lambda f, columns: f(*columns) if len(columns) > 1 else columns[0]
    total = places[0]
    for p in places[1:]:
        total = total + p

    blocks = F.transform(F.split("_low", "\n"), lambda b: F.array_intersect(F.split(F.regexp_replace(b, BETWEEN, " "), " "), known))
    blocks = F.filter(blocks, lambda b: (F.size(b) >= least) & F.arrays_overlap(b, F.array(*map(F.lit, first_words))))
    ranked = F.transform(blocks, lambda b: F.array_sort(F.transform(b, lambda w: (F.array_position(known, w) - 1).cast("int"))))
    nothing = F.array().cast("array<struct<label:string,share:double>>")
    matched = F.when(F.arrays_overlap("_words", F.array(*map(F.lit, first_words))), F.concat(F.flatten(F.transform(ranked, contained)), wrapped(F.col("_words")))).otherwise(nothing) if sized else nothing
    rows = rows.select(
        *others,
        F.when(line == "  ", 0).otherwise(F.size("_words")).cast("long").alias("n_words"),
        total.cast("long").alias("n_base"),
        one(F.least, first).cast("long").alias("first_word"),
        one(F.greatest, last).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*base)))).alias("_base"),
        matched.alias("_matched"),
    )
    labels = F.array_sort(F.array_union("_base", F.transform("_matched", lambda m: m["label"])))
    score = F.when(F.size("_base") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("_matched", lambda m: m["share"])), F.lit(0.0)))
    return rows.select(*others, "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def oracle(phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8) -> str:
    """DuckDB SQL for ``scan_licenses`` over ``documents``, without any filter."""
    low = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
    squeeze = lambda x: f"trim(regexp_replace({x}, '{BETWEEN}', ' ', 'g'))"
    count, first, last, label = [], [], [], []
    for phrase, name in phrases.items():
        twice = " " + phrase.replace(" ", "  ") + " "
        count.append(f"CAST((length(replace(line, ' ', '  ')) - length(replace(replace(line, ' ', '  '), '{twice}', ''))) / {len(twice)} AS BIGINT)")
        before = lambda at: f"length(line[1:{at} - 1]) - length(replace(line[1:{at} - 1], ' ', ''))"
        at = f"strpos(line, ' {phrase} ')"
        first.append(f"CASE WHEN {at} > 0 THEN {before(at)} END")
        back = f"(length(line) - strpos(reverse(line), '{(' ' + phrase + ' ')[::-1]}') - {len(phrase) + 2} + 2)"
        last.append(f"CASE WHEN {at} > 0 THEN {before(back)} END")
        label.append(f"CASE WHEN {at} > 0 THEN '{name}' END")
    values = ", ".join(f"('{k}', {sorted(set(t.split()))!r}, {needed(len(set(t.split())), threshold)})" for k, t in templates.items())
    return f"""
WITH d AS (SELECT doc_id, {low} AS low, ' ' || {squeeze(low)} || ' ' AS line FROM documents),
t(label, words, need) AS (VALUES {values}),
b AS (SELECT doc_id, string_split({squeeze("block")}, ' ') AS words FROM (SELECT doc_id, unnest(string_split(low, chr(10))) AS block FROM d)),
m AS (SELECT doc_id, label, len(list_intersect(b.words, t.words)) / len(t.words) AS share FROM b, t WHERE len(list_intersect(b.words, t.words)) >= need),
g AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM m GROUP BY doc_id),
x AS (SELECT doc_id, line,
  {" + ".join(count)} AS n_base, least({", ".join(first)}) AS first_word, greatest({", ".join(last)}) AS last_word,
  list_filter([{", ".join(label)}], lambda v: v IS NOT NULL) AS base FROM d)
SELECT x.doc_id, CASE WHEN line = '  ' THEN 0 ELSE len(string_split(trim(line), ' ')) END AS n_words,
  n_base, first_word, last_word, coalesce(array_to_string(list_sort(list_distinct(base)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, CAST([] AS VARCHAR[]))))), ','), '') AS labels,
  CASE WHEN len(base) > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM x LEFT JOIN g USING (doc_id)"""
