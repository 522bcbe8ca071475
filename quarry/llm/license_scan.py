"""License scans: exact set-similarity join of text blocks with notice templates, in DataFrame functions only.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z. Base: the places where the words of
a phrase of ``PHRASES`` stand one after another.

Method: blocks are the stretches of ``window`` words, at half that step, of the whole text, line breaks or
not, so that any notice of up to ``window / 2 + 1`` words lies whole in one; and the lines, those above
``window`` words in stretches likewise. A block carries a template's label when it holds at least ``threshold``
of the template's distinct words. The templates' words are ordered by the number of documents that have them, rarest first, ties by
the word. A block that reaches ``need = ceil(threshold * |T|)`` must share one of the first ``|T| - need + 1``
words of T (prefix), have ``need`` words (length), and where T's word i equals the block's word j, the words
on both sides must suffice: ``min(i, j) + 1 + min(|T| - i, |B| - j) - 1 >= need`` (position). What passes is
counted exactly. Only words of templates can count, so blocks are held as sorted ranks of those words.
The templates are a parameter; their tables have a row per word and are broadcast.

``score`` is 1 for documents with a base phrase, else the largest share reached by a block that carries a
label, else 0.

Defined results: null text is empty (no words, no labels); every row is judged by itself and repeated rows
get equal results; null ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases and labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: label -> notices; parameters of the method.
TEMPLATES = {
    "mit": ["released under the mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
    "apache": ["licensed under the apache license version 2 0"],
    "gpl": ["this work is licensed under the gnu general public license version 3",
            "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "lgpl": ["licensed under the gnu lesser general public license version 3"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "mpl": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "cc-by": ["licensed under a creative commons attribution 4 0 international license"],
    "cc-by-nc": ["licensed under cc by nc 4 0"],
    "cc-by-sa": ["licensed under cc by sa 4 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}
THRESHOLD, WINDOW = 0.8, 64
WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GAP = r"[^0-9A-Za-z\x80-\x{10FFFF}]"


def _sql(pattern: str) -> str:
    """A pattern as a SQL string literal."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def phrase_pattern(phrases) -> str:
    return rf"(?<!{WORD})(?:" + "|".join(p.replace(" ", f"{GAP}+") for p in phrases) + rf")(?!{WORD})"


def base_columns(text: str = "_text") -> dict:
    """``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels`` as SQL; positions are counts of
    the words in front of a match, and only texts with a phrase look for them."""
    every = phrase_pattern(PHRASES)
    count = lambda x: f"cast(regexp_count({x}, {_sql(WORD + '+')}) as bigint)"
    has = f"{text} rlike {_sql('(?i)' + every)}"
    front = f"regexp_extract({text}, {_sql('(?is)^(.*?)' + every)}, 1)"
    rest = f"regexp_extract({text}, {_sql('(?is)^(.*)' + every)}, 1)"
    labels = ", ".join(f"CASE WHEN {text} rlike {_sql('(?i)' + phrase_pattern([p]))} THEN '{label}' END"
                       for p, label in PHRASES.items())
    return {
        "n_words": count(text),
        "n_base": f"CASE WHEN _has THEN cast(regexp_count({text}, {_sql('(?i)' + every)}) as bigint) ELSE 0L END",
        "first_word": f"CASE WHEN _has THEN {count(front)} END",
        "last_word": f"CASE WHEN _has THEN {count(rest)} END",
        "_base": f"CASE WHEN _has THEN array_sort(array_distinct(array_compact(array({labels})))) ELSE cast(array() as array<string>) END",
        "_has": has,
    }


def template_table(spark, docs: DataFrame, templates: dict, threshold: float):
    """``(ranks, prefix)``: each template word's rank by document frequency, and a row
    ``(rank, template, label, at, ranks, need)`` per prefix word."""
    sets = [(i, label, sorted(set(text.split()))) for i, (label, text) in
            enumerate((label, t) for label, ts in templates.items() for t in ts)]
    vocab = sorted({w for _, _, ws in sets for w in ws})
    # alternatives longest first: a word is taken whole because word characters may not follow
    pattern = rf"(?i)(?<!{WORD})(?:" + "|".join(sorted(vocab, key=lambda w: (-len(w), w))) + rf")(?!{WORD})"
    found = docs.select(F.explode(F.expr(
        f"array_distinct(transform(regexp_extract_all(_text, {_sql(pattern)}, 0), w -> lower(w)))")).alias("word"))
    counts = {r.word: r.n for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}  # a row per template word
    ranks = {w: i for i, w in enumerate(sorted(vocab, key=lambda w: (counts.get(w, 0), w)))}
    rows = []
    for i, label, words in sets:
        order = sorted(ranks[w] for w in words)
        need = math.ceil(threshold * len(order) - 1e-9)
        rows += [(order[j], i, label, j, order, need) for j in range(len(order) - need + 1)]
    return ranks, spark.createDataFrame(
        rows, "rank int, template int, label string, at int, ranks array<int>, need int")


def blocks(docs: DataFrame, ranks: dict, prefix_words: list, window: int) -> DataFrame:
    """``(_id, _hash, n, b)``: blocks with a prefix word, their number of distinct words and the sorted ranks of
    their template words. Of the whole text only the stretches around a prefix word are made."""
    pattern = rf"(?i)(?<!{WORD})(?:" + "|".join(sorted(prefix_words, key=lambda w: (-len(w), w))) + rf")(?!{WORD})"
    step = window // 2
    words = lambda x: (f"transform(regexp_extract_all({x}, {_sql(WORD + '+')}, 0), "  # noqa: E731
                       f"w -> translate(w, '{ASCII_UPPER}', '{ASCII_UPPER.lower()}'))")
    last = lambda w: f"cast(greatest(ceil((size({w}) - {window}) / {step}D), 0) as int)"
    rows = docs.where(F.col("_text").rlike(pattern)).select("_id", "_hash", "_text", F.expr(words("_text")).alias("_w"))
    known = ", ".join(_sql(w) for w in prefix_words)
    rows = rows.withColumn("_at", F.expr(f"filter(sequence(0, size(_w) - 1), i -> get(_w, i) IN ({known}))"))
    # stretch k holds words k * step to k * step + window - 1: word i lies in the stretches i div step and the one before
    rows = rows.withColumn("_k", F.expr(
        f"filter(array_distinct(flatten(transform(_at, i -> array(cast(i div {step} as int), cast(i div {step} as int) - 1)))), "
        f"k -> k >= 0 AND k <= {last('_w')})"))
    rows = rows.withColumn("_lines", F.expr(f"transform(filter(split(_text, '\\n'), l -> l rlike {_sql(pattern)}), l -> {words('l')})"))
    cut = rows.select("_id", "_hash", F.explode(F.expr(
        f"concat(transform(_k, k -> slice(_w, k * {step} + 1, {window})), flatten(transform(_lines, l -> CASE WHEN size(l) <= {window} "
        f"THEN array(l) ELSE transform(sequence(0, {last('l')}), i -> slice(l, i * {step} + 1, {window})) END)))")).alias("w"))
    table = F.create_map(*[F.lit(x) for w, r in ranks.items() for x in (w, r)])
    return (cut.withColumn("_ranks", table)
            .select("_id", "_hash", F.size(F.array_distinct("w")).alias("n"),
                    F.expr("sort_array(array_distinct(filter(transform(w, x -> _ranks[x]), r -> r is not null)))").alias("b")))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict | None = None,
                 threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """One row per input row: id, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``."""
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    rows = rows.withColumn("_hash", F.xxhash64("_text"))
    ranks, prefix = template_table(docs.sparkSession, rows, templates or TEMPLATES, threshold)
    words = {r: w for w, r in ranks.items()}
    first = sorted({words[r.rank] for r in prefix.select("rank").distinct().collect()})
    b = blocks(rows, ranks, first, window)
    pairs = (b.withColumn("block", F.struct("n", "b")).select("_id", "_hash", "block", F.posexplode("block.b").alias("j", "rank"))
             .join(F.broadcast(prefix), "rank"))
    size, t = F.size("block.b"), F.size("ranks")
    pairs = pairs.where((F.col("block.n") >= F.col("need")) & (size >= F.col("need"))
                        & (F.least("at", "j") + F.least(t - F.col("at"), size - F.col("j")) >= F.col("need")))
    share = F.size(F.array_intersect("ranks", "block.b"))
    found = pairs.withColumn("common", share).where(F.col("common") >= F.col("need"))
    # a block meets a template once per shared prefix word; per document a label and a maximum are kept
    found = (found.groupBy(F.col("_id").alias("_i"), F.col("_hash").alias("_h"))
             .agg(F.collect_set("label").alias("_found"), F.max(F.col("common") / t).alias("_share")))
    base = base_columns()
    out = rows.withColumn("_has", F.expr(base.pop("_has"))).select("_id", "_hash", *[F.expr(x).alias(c) for c, x in base.items()])
    out = out.join(found, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_hash") == F.col("_h")), "left")
    every = F.array_sort(F.array_union("_base", F.coalesce("_found", F.array().cast("array<string>"))))
    return out.select(F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
                      F.concat_ws(",", "_base").alias("base_labels"), F.concat_ws(",", every).alias("labels"),
                      F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("_share", F.lit(0.0))).alias("score"))


def oracle_sql() -> str:
    """DuckDB SQL of :func:`license_scan` over ``documents``: every block against every template, no filters."""
    table = ", ".join("({}, '{}', [{}])".format(i, label, ", ".join(f"'{w}'" for w in sorted(set(t.split())))) for i, (label, t) in
                      enumerate((label, t) for label, ts in TEMPLATES.items() for t in ts))
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hits = " UNION ALL ".join(
        "SELECT rid, i - 1 AS pos, '{}' AS label FROM p WHERE {}".format(
            label, " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))) for phrase, label in PHRASES.items())
    step = WINDOW // 2
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {low.format("coalesce(text, '')")} AS t FROM documents),
w AS (SELECT rid, doc_id, regexp_extract_all(t, '{word}') AS w FROM d),
p AS (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM w WHERE list_contains(w, 'license')),
hits AS ({hits}),
base AS (SELECT rid, count(*) AS n, min(pos) AS a, max(pos) AS z, list(DISTINCT label) AS labels FROM hits GROUP BY rid),
lines AS (SELECT rid, regexp_extract_all(l, '{word}') AS w FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d)),
cut AS (SELECT rid, unnest(CASE WHEN len(w) <= {WINDOW} THEN [w] ELSE list_transform(
  range(0, CAST(ceil((len(w) - {WINDOW}) / {step}.0) AS BIGINT) + 1), lambda i: w[i * {step} + 1:i * {step} + {WINDOW}]) END) AS w
  FROM (SELECT rid, w FROM lines UNION ALL SELECT rid, w FROM w)),
tpl AS (SELECT * FROM (VALUES {table}) v(id, label, t)),
near AS (SELECT rid, label, len(list_intersect(t, w)) / len(t) AS share FROM cut, tpl WHERE len(w) > 0 AND list_has_any(t, w)),
found AS (SELECT rid, list(DISTINCT label) AS labels, max(share) AS share FROM near WHERE share >= {THRESHOLD} - 1e-9 GROUP BY rid)
SELECT doc_id, len(w.w) AS n_words, coalesce(base.n, 0) AS n_base, base.a AS first_word, base.z AS last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ',') AS labels,
  CASE WHEN base.n > 0 THEN 1.0 ELSE coalesce(found.share, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN base ON w.rid = base.rid LEFT JOIN found ON w.rid = found.rid"""
