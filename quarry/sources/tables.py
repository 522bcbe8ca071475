"""Logical tables and the adapters that build them from the driver's tables.

Adapter rules (documented stand-ins, see README):

* blocks (passages): ``documents``; vectors from ``embeddings`` on
  ``vec_id = doc_id``, where there are any.
* questions: a user turn ``t``, with the assistant turn ``t + 1`` of the
  same conversation as its answer where there is one; ``sample_id = conv_id * 100 + t``; split by
  ``conv_id % 10``: 0 -> eval, 1 -> test, else train; test keeps no answer.
* query vectors: the embedding with ``vec_id = sample_id % count(embeddings)``
  (stands in for a query encoder).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions.text import strip_ws
from quarry.params import SPLITS

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def split_of(conv_id: Column) -> Column:
    r = F.pmod(conv_id, F.lit(10))
    return F.when(r == 0, "eval").when(r == 1, "test").otherwise("train")


def blocks(spark: SparkSession, sf_dir: str, with_vectors: bool = True) -> DataFrame:
    """``block_id, text[, embedding]`` -- every passage, addressable by id (src_blocks); a passage
    without a vector keeps a null embedding."""
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("block_id"), "text")
    if not with_vectors:
        return d
    e = read_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("block_id"), "embedding")
    return d.join(e, "block_id", "left")


def block_vectors(spark: SparkSession, sf_dir: str, dim: int | None = None,
                  vector_names=("embedding", "block_emb")) -> DataFrame:
    """``block_id, embedding`` for blocks that have text (src_vectors).

    The vector column is looked up by name with fallbacks (first of
    ``vector_names`` present). With ``dim`` given, rows of another width raise at
    run time (``raise_error`` inside the plan, no driver round trip).
    """
    d = read_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("block_id"))
    raw = read_table(spark, sf_dir, "embeddings")
    name = next((n for n in vector_names if n in raw.columns), None)
    if name is None:
        raise KeyError(f"no vector column among {list(vector_names)}")
    e = raw.select(F.col("vec_id").alias("block_id"), F.col(name).alias("embedding"))
    out = e.join(d, "block_id", "left_semi")
    if dim is not None:
        out = out.withColumn("embedding", F.when(F.size("embedding") == dim, F.col("embedding"))
                             .otherwise(F.raise_error(F.format_string(
                                 "vector width %d, expected %d", F.size("embedding"), F.lit(dim)))))
    return out


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``split, sample_id, question, answer`` -- src_questions / qa_project: every user turn. The answer is
    NULL on test and where no assistant turn follows."""
    conv = read_table(spark, sf_dir, "conversations")
    u = conv.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))
    a = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    q = u.join(a, ["conv_id", "turn"], "left")
    split = split_of(F.col("conv_id"))
    return q.select(
        split.alias("split"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("sample_id"),
        "question",
        F.when(split == "test", F.lit(None).cast("string")).otherwise(F.col("answer")).alias("answer"),
    )


def qa_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question records in the reference's nested shape, derived from the conversations:
    ``split, id STRING, input STRING, output ARRAY<STRUCT<answer STRING>>`` -- one record
    per user turn, ``output`` = the following assistant turn (none on test).
    The split column uses the reference's raw name ``validation`` for eval."""
    q = questions(spark, sf_dir)
    return q.select(
        F.when(F.col("split") == "eval", "validation").otherwise(F.col("split")).alias("split"),
        F.col("sample_id").cast("string").alias("id"), F.col("question").alias("input"),
        F.when(F.col("answer").isNull(), F.array().cast("array<struct<answer:string>>"))
         .otherwise(F.array(F.struct(F.col("answer").alias("answer")))).alias("output"))


def questions_from_records(records: DataFrame) -> DataFrame:
    """Nested question records -> ``split, sample_id, question, answers, answer``.

    ``answers = transform(output, o -> o.answer)``; the cached answer is the first
    one (``try_element_at``); test rows keep no answer; ``validation`` is named
    ``eval`` (the reader and writer of the reference disagree on the name).
    """
    split = F.when(F.col("split") == "validation", "eval").otherwise(F.col("split"))
    answers = F.transform(F.col("output"), lambda o: o["answer"])
    return records.select(
        check_split(split).alias("split"), F.col("id").cast("long").alias("sample_id"),
        F.col("input").alias("question"),
        F.when(split == "test", F.lit(None).cast("array<string>")).otherwise(answers).alias("answers"),
        F.when(split == "test", F.lit(None).cast("string"))
         .otherwise(F.try_element_at(answers, F.lit(1))).alias("answer"))


def first_question_shortest_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, question, answer, n_answers`` -- per conversation, its first user
    turn and its shortest assistant turn (characters before trimming, earlier turn
    on ties), whitespace-trimmed.

    Both are ``min_by`` aggregates: partial aggregation on the map side, so a
    conversation holding a huge share of all turns never becomes one big group.
    """
    conv = read_table(spark, sf_dir, "conversations")
    first_q = (conv.where(F.col("role") == "user")
               .groupBy("conv_id").agg(F.min_by("text", "turn").alias("question")))
    shortest = (conv.where(F.col("role") == "assistant")
                .groupBy("conv_id")
                .agg(F.min_by("text", F.struct(F.length("text"), F.col("turn"))).alias("answer"),
                     F.count(F.lit(1)).alias("n_answers")))
    return first_q.join(shortest, "conv_id").select(
        "conv_id", "question", strip_ws(F.col("answer")).alias("answer"), "n_answers")


def shortest_answer(answers: Column) -> Column:
    """In-row version for nested records (``answers ARRAY<STRING>``): the answer of
    least length, first on ties, trimmed."""
    pos = F.transform(answers, lambda a, i: F.struct(F.length(a).alias("l"), i.alias("p"), a.alias("a")))
    return strip_ws(F.element_at(F.array_sort(pos), 1)["a"])


def query_vectors(spark: SparkSession, sf_dir: str, qs: DataFrame | None = None) -> DataFrame:
    """``split, sample_id, embedding``: the stand-in encoder output for each question."""
    qs = qs if qs is not None else questions(spark, sf_dir)
    emb = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    n = emb.count()  # row total: bounded metadata
    return (qs.select("split", "sample_id", F.pmod(F.col("sample_id"), F.lit(n)).alias("vec_id"))
            .join(emb, "vec_id").drop("vec_id"))


def benchmark_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unanswered extra questions (``split='test'``), ids offset so they never
    collide with conversation-derived sample ids."""
    b = read_table(spark, sf_dir, "benchmark")
    return b.select(F.lit("test").alias("split"), (F.lit(10**12) + F.col("item_id")).alias("sample_id"),
                    F.col("text").alias("question"), F.lit(None).cast("string").alias("answer"))


def metrics_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``split, event_id, ts, user_id, loss, batch_size``: the events table read as a
    metrics log (split = event_type, loss = value, batch size = ``props.k``)."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(F.col("event_type").alias("split"), "event_id", "ts", "user_id",
                     F.col("value").alias("loss"),
                     F.get_json_object("props", "$.k").cast("long").alias("batch_size"))


def check_split(col: Column) -> Column:
    """Membership check for split names (enum_check): fails the job on a stray value."""
    return F.when(col.isin(*SPLITS), col).otherwise(
        F.raise_error(F.concat(F.lit("unknown split: "), F.coalesce(col, F.lit("NULL")))))


def import_positional(spark: SparkSession, path: str, id_col: str = "block_id") -> DataFrame:
    """Read a Parquet dataset whose record identity is its position (file order,
    then row order inside the file) and make the position an explicit id column.

    The position is the row's index in its file (``_metadata.row_index``) plus the rows of
    the files before, summed over one row per file; the records themselves never move.
    """
    df = spark.read.parquet(path)
    file = F.col("_metadata.file_path")
    sizes = df.select(file.alias("_file")).groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    sizes = sizes.select("_file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    rows = df.select(*df.columns, file.alias("_file"), F.col("_metadata.row_index").alias("_row"))
    return rows.join(F.broadcast(sizes), "_file").select(
        (F.col("_from") + F.col("_row")).alias(id_col), *df.columns)
