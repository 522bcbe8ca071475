"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Measures of a whole text (words ``[^\\x20\\x09-\\x0D]+``): words, code points in words,
characters of ``#*$%&|<>``, lines with a word that equal an earlier line, and words inside a
3-word window that occurs twice or more. A document fails the base rules below 50 words or
with more than half of its words in repeated windows.

Method: a rule is a ratio and its cutoffs, widest first; it rejects what lies above its cutoff. ``PATH`` is
a fixed order of sets of cutoffs, one rule's cutoff narrowed a step, so every set rejects all that the one
before it rejects. The labelled good documents that pass the base rules are the holdout of their stratum. With
n of them and k rejected by *any* rule of a set, "this set rejects more than ``risk`` of the good documents" is
refuted when the exact binomial tail P(Bin(n, risk) <= k) is at most ``error`` over the number of strata
(Bonferroni), the one-sided Clopper-Pearson bound. The sets are tested in their fixed order up to the first that
isn't refuted (k never falls along the path, so the refuted ones are the first ones), which needs no correction
within a stratum. All strata together keep their bound on the joint false rejection with probability ``1 - error``.
Among the refuted sets the one that rejects most labelled bad documents is taken, the first of them on ties. A
stratum without such a set rejects nothing beyond the base: below ln(strata / error) / risk good labels none has one.

The measures are written once with the rows (no shuffle of texts) and labels meet the measures only. The
cutoffs, a row per stratum, are broadcast up to ``MAX_SENT`` rows and joined by a shuffle beyond.

Defined results: null text has no words; a null stratum value is a stratum of its own; each input
row is judged by itself, repeated rows included; several labels of one id: the lowest quality holds;
labels without id or quality are ignored; rows with a null id have no label; empty tables give empty
results; other columns are carried as they are by ``quality_filter`` and ignored by
``quality_verdicts``, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: name -> (numerator, denominator, scale, cutoffs); a rule rejects ratios above its cutoff.
RULES = {
    "symbols": ("n_symbols", "word_chars", 1_000_000, (10_000, 20_000, 50_000, 100_000, 150_000, 200_000)),
    "repeats": ("n_repeat_words", "n_words", 1_000_000, (100_000, 150_000, 200_000, 250_000, 300_000, 400_000)),
    "dup_lines": ("n_dup_lines", "n_lines", 1_000_000, (100_000, 200_000, 300_000, 400_000, 500_000, 700_000)),
    "long_words": ("word_chars", "n_words", 1_000, (6_500, 7_000, 8_000, 9_000, 10_000, 12_000)),
}
#: The sets tested, in this order: step s narrows rule s mod 4; a rule's cutoff, or None while it doesn't act.
PATH = [{r: (sorted(cuts, reverse=True)[(s - i) // len(RULES)] if s >= i else None) for i, (r, (_, _, _, cuts)) in enumerate(RULES.items())}
        for s in range(sum(len(cuts) for _, _, _, cuts in RULES.values()))]
RISK, ERROR = 0.005, 0.05
MAX_SENT = 100_000
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def measure(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """``rows`` with one struct column ``_quality`` of the measures; steps that are used more
    than once get a column each, so that none is computed twice."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bare = F.btrim(F.col("_t"), F.lit(SPACE))
    df = rows.withColumn("_t", text).withColumn("_b", bare)
    df = df.withColumn("_w", F.when(F.col("_b") == "", F.array().cast("array<string>"))
                       .otherwise(F.split("_b", "[\\x20\\x09-\\x0D]+")))
    df = df.withColumn("_l", F.expr(f"filter(split(_t, '\\n'), l -> btrim(l, '{SPACE_SQL}') <> '')"))
    df = df.withColumn("_h", F.expr(
        "CASE WHEN size(_w) >= 3 THEN transform(sequence(0, size(_w) - 3), "
        "i -> xxhash64(get(_w, i), get(_w, i + 1), get(_w, i + 2))) ELSE cast(array() as array<bigint>) END"))
    # the positions sorted by window; only texts in which some window comes again
    df = df.withColumn("_s", F.expr(
        "CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (h, i) -> struct(h, i))) END"))
    df = df.withColumn("_p", F.expr(
        "sort_array(transform(filter(_s, (x, i) -> get(_s, i + 1).h <=> x.h OR (i > 0 AND get(_s, i - 1).h <=> x.h)), "
        "x -> x.i))"))
    covered = F.expr("coalesce(aggregate(transform(_p, (x, i) -> least(3, coalesce(get(_p, i + 1) - x, 3))), 0L, "
                     "(a, x) -> a + x), 0L)")
    spaces = F.length("_t") - F.length(F.translate("_t", SPACE, ""))
    df = df.withColumn("_quality", F.struct(
        F.size("_w").cast("long").alias("n_words"),
        (F.length("_t") - spaces).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").cast("long").alias("n_lines"),
        covered.alias("n_repeat_words")))
    return df.select(*[F.col(f"`{c}`") for c in rows.columns], "_quality")


SPACE_SQL = "".join(f"\\u{ord(c):04x}" for c in SPACE)


def base_failed(m: str = "_quality"):
    return (F.col(f"{m}.n_words") < 50) | (100 * F.col(f"{m}.n_repeat_words") > 50 * F.col(f"{m}.n_words"))


def ratio(rule: str, m: str = "_quality"):
    num, den, scale, _ = RULES[rule]
    return F.expr(f"{m}.{num} * {scale}L div greatest({m}.{den}, 1L)")


def tail_at_most(risk: float, alpha):
    """Whether P(Bin(n, risk) <= k) <= alpha; past the mean it can't be, so no sum runs longer than n * risk."""
    import math
    odds, miss = math.log(risk / (1 - risk)), math.log1p(-risk)
    total = (f"aggregate(sequence(0L, k), named_struct('t', n * {miss!r}D, 's', 0D), (a, j) -> named_struct("
             f"'t', a.t + {odds!r}D + ln(cast(n - j AS double) / (j + 1)), 's', a.s + exp(a.t)), a -> a.s)")
    return F.expr(f"CASE WHEN n = 0 OR k >= n * {risk!r}D THEN false ELSE {total} <= {alpha} END")


def select_cutoffs(labelled: DataFrame, risk: float = RISK, error: float = ERROR) -> DataFrame:
    """``(stratum, <rule> ...)`` with each rule's cutoff (null: the rule doesn't act), from rows
    ``(stratum, quality, _quality)`` of labelled documents."""
    seen = labelled.where(~base_failed())
    hit = [reduce(lambda a, b: a | b, [ratio(r) > F.lit(c) for r, c in cuts.items() if c is not None]) for cuts in PATH]
    above = [F.sum(F.when((F.col("quality") == q) & h, 1).otherwise(0)).alias(f"s{s}_{q}") for s, h in enumerate(hit) for q in (0, 1)]
    counts = written(seen.groupBy("stratum").agg(F.sum((F.col("quality") == 1).cast("long")).alias("n"), *above), "counts")
    strata = max(counts.count(), 1)  # a row per stratum
    cells = F.array(*[F.struct(F.lit(s).alias("step"), F.col(f"s{s}_1").alias("k"), F.col(f"s{s}_0").alias("bad"),
                               *[F.lit(cuts[r]).cast("long").alias(r) for r in RULES]) for s, cuts in enumerate(PATH)])
    cells = counts.select("stratum", "n", F.inline(cells))
    sound = cells.where(tail_at_most(risk, f"{error / strata!r}D"))
    best = F.max_by(F.struct(*RULES), F.struct(F.col("bad"), -F.col("step")))
    return sound.groupBy("stratum").agg(best.alias("best")).select("stratum", "best.*")


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           stratum_col: str = "lang", risk: float = RISK, error: float = ERROR, carry: list | None = None) -> DataFrame:
    """``docs`` (or its columns ``carry``) packed as ``_row`` with ``_quality``, ``_base`` (fails the base) and ``_failed`` (rules it breaks)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or docs.columns]).alias("_row"),
                       F.col(text_col).alias("_text"),
                       F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit("")).alias("stratum"))
    rows = written(measure(rows, "_text").drop("_text"), "quality")
    marks = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("quality")))
    labelled = (rows.select(F.col(f"_row.{id_col}").alias("_id"), "stratum", "_quality").join(marks, "_id"))
    cutoffs = written(select_cutoffs(labelled, risk, error), "cutoffs")
    # a row per stratum with a cutoff: sent to the rows while they are few, shuffled together with them beyond
    rows = rows.join(F.broadcast(cutoffs) if cutoffs.count() <= MAX_SENT else cutoffs, "stratum", "left")
    broken = F.array_compact(F.array(*[F.when(ratio(r) > F.col(r), F.lit(r)) for r in RULES]))
    return rows.select("_row", "_quality", base_failed().alias("_base"), F.concat_ws(",", broken).alias("_failed"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """One row per input row: id, words, code points, symbols, repeated lines and words, ``base_failed``, ``kept``; then
    ``n_lines`` and ``failed_rules``."""
    extra = "n_lines"
    return judged(docs, labels, id_col=id_col, carry=[id_col], **kw).select(
        F.col(f"_row.{id_col}").alias(id_col), *[F.col(f"_quality.{m}").alias(m) for m in MEASURES if m != extra],
        F.col("_base").alias("base_failed"), (~F.col("_base") & (F.col("_failed") == "")).alias("kept"),
        F.col(f"_quality.{extra}").alias(extra), F.col("_failed").alias("failed_rules"))


def quality_filter(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns."""
    return judged(docs, labels, **kw).where(~F.col("_base") & (F.col("_failed") == "")).select("_row.*")


def oracle_sql() -> str:
    """DuckDB SQL of :func:`quality_verdicts` over ``documents`` and ``labels``."""
    import math
    rat = {r: f"({n} * {s}) // greatest({d}, 1)" for r, (n, d, s, _) in RULES.items()}
    hit = [" OR ".join(f"{rat[r]} > {c}" for r, c in cuts.items() if c is not None) for cuts in PATH]
    cells = " UNION ALL ".join(
        f"SELECT stratum, {s} AS step, count(*) FILTER (quality = 1) AS n, count(*) FILTER (quality = 1 AND ({h})) AS k, "
        f"count(*) FILTER (quality = 0 AND ({h})) AS bad FROM held GROUP BY stratum" for s, h in enumerate(hit))
    steps = ", ".join("({})".format(", ".join([str(s)] + [str(c if c is not None else "NULL") for c in cuts.values()])) for s, cuts in enumerate(PATH))
    odds, miss = math.log(RISK / (1 - RISK)), math.log1p(-RISK)
    broken = ", ".join(f"CASE WHEN {rat[r]} > c_{r} THEN '{r}' END" for r in RULES)
    ws = " || ".join(f"chr({ord(c)})" for c in SPACE)
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || lang, '') AS stratum, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda l: trim(l, {ws}) <> '') AS l FROM t),
grams AS (SELECT rid, unnest(range(1, greatest(len(w) - 1, 1))) AS i, w FROM w WHERE len(w) >= 3),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM grams),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
cover AS (SELECT rid, count(DISTINCT i + o) AS n FROM again, (VALUES (0), (1), (2)) v(o) GROUP BY rid),
m AS (SELECT w.rid, doc_id, stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(t) - length(translate(t, '{SYMBOLS}', '')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
  len(l) AS n_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN cover ON w.rid = cover.rid),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
held AS (SELECT v.*, quality FROM v JOIN (SELECT doc_id, min(quality) AS quality FROM labels
  WHERE quality IS NOT NULL GROUP BY doc_id) x ON v.doc_id = x.doc_id WHERE NOT base_failed),
cells AS ({cells}),
terms AS (SELECT stratum, step, n, k, bad, j, n * {miss!r} + coalesce(sum({odds!r} + ln(CAST(n - j + 1 AS DOUBLE) / j))
  FILTER (j > 0) OVER (PARTITION BY stratum, step ORDER BY j), 0) AS lt
  FROM (SELECT *, unnest(range(0, k + 1)) AS j FROM cells WHERE n > 0 AND k < n * {RISK!r})),
sound AS (SELECT stratum, step, k, bad FROM terms GROUP BY stratum, step, k, bad
  HAVING sum(exp(lt)) <= {ERROR!r} / (SELECT count(DISTINCT stratum) FROM held)),
best AS (SELECT stratum, step FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY bad DESC, step) AS r FROM sound) WHERE r = 1),
cuts AS (SELECT stratum, x.* FROM best JOIN (VALUES {steps}) x(step, {", ".join("c_" + r for r in RULES)}) ON best.step = x.step),
f AS (SELECT v.*, concat_ws(',', {broken}) AS failed_rules FROM v LEFT JOIN cuts ON v.stratum = cuts.stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words, base_failed, failed_rules,
  NOT base_failed AND failed_rules = '' AS kept FROM f"""
