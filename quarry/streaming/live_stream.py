"""Retrieval for questions that arrive as a stream, from an index at rest.

A micro-batch of questions is joined with the stored index: the leaves of its questions are looked up first, and only
these leaves' folders are read (partition pruning), so the work of a batch goes with its questions and not with the
index. The answers of a batch are written under its number. A batch that runs again after a failure overwrites its own
answers, so every question is answered once, whatever is lost in between; a stream that was stopped goes on in the same folder.

Defined results: a question without a vector, or with a null or non-finite entry, gets no passages; an id that arrives twice is
answered by its newest batch, twice in one batch by its least vector; ties go to the smaller passage id; an empty
batch writes nothing. A hit whose passage isn't in the passage table is left out, as in the batch query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators.ann import ivf_probe
from quarry.operators.retrieval import gather_blocks
from quarry.operators.search import topk_small_side
from quarry.session import scratch_path, ship_package

ANSWERS = "sample_id long, rank long, block_id long, score double, text string"


class LiveRetrieval:
    """Answers ``sample_id, embedding`` rows from ``index`` (as ``write_index`` stores it) and ``passages``.

    ``path`` holds the stream's checkpoint and its answers; a stream started again with it continues."""

    def __init__(self, spark: SparkSession, index: DataFrame, centroids: DataFrame, passages: DataFrame, *, nprobe: int,
                 k: int = 10, spilled: bool = True, path: str | None = None):
        ship_package(spark)
        self.spark, self.index, self.centroids, self.passages = spark, index, centroids, passages
        self.nprobe, self.k, self.spilled = nprobe, k, spilled
        self.path = path or scratch_path(spark, "live")
        self.leaves_read: dict = {}     # batch: number of leaves it read

    def _written(self, df: DataFrame, table: str, n: int) -> DataFrame:
        at = f"{self.path}/{table}/{n}"
        df.write.mode("overwrite").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def needed(self, leaves: list) -> DataFrame:
        """The part of the index in ``leaves``; the other folders are not read."""
        return self.index.where(F.col("leaf").isin(leaves))

    def batch(self, arrived: DataFrame, n: int):
        vector = F.col("embedding").cast("array<double>")
        finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        asked = arrived.select(F.col("sample_id").cast("long").alias("qid"), F.when(finite & (F.size(vector) > 0), vector).alias("embedding"))
        asked = self._written(asked.groupBy("qid").agg(F.min("embedding").alias("embedding")), "asked", n)
        asked = asked.where("qid IS NOT NULL AND embedding IS NOT NULL")
        n_asked = asked.count()
        if not n_asked:
            self.leaves_read[n] = 0
            self.spark.createDataFrame([], ANSWERS).write.mode("overwrite").parquet(f"{self.path}/answers/batch={n}")
            return
        probes = self._written(topk_small_side(asked, self.centroids, self.nprobe, qid_col="qid", small_id_col="leaf",
                                               carry_vectors=True), "probes", n)
        leaves = sorted(r[0] for r in probes.select("block_id").distinct().collect())    # at most the number of leaves
        self.leaves_read[n] = len(leaves)
        hits = ivf_probe(asked, self.needed(leaves), self.centroids, self.nprobe, self.k, spilled=self.spilled, probes=probes)
        hits = self._written(hits.withColumnRenamed("qid", "sample_id"), "hits", n)
        found = gather_blocks(hits, self.passages.select("block_id", "text"), n_hits=n_asked * self.k)
        found.select("sample_id", "rank", "block_id", "score", "text").write.mode("overwrite").parquet(f"{self.path}/answers/batch={n}")

    def run(self, source_dir: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
        """Answers everything that has arrived so far."""
        src = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source_dir)
        q = (src.writeStream.foreachBatch(self.batch).option("checkpointLocation", f"{self.path}/checkpoint").start())
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return self.answers()

    def answers(self) -> DataFrame:
        """``sample_id, rank, block_id, score, text``: per question those of the newest batch it came in."""
        schema = T.StructType.fromDDL(ANSWERS).add("batch", T.LongType())
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/answers")
        asked = self.spark.read.schema("qid long").parquet(f"{self.path}/asked/*")
        again = asked.where("qid IS NOT NULL").groupBy("qid").count().where("count > 1").select("qid")
        if again.head(1):
            number = F.regexp_extract(F.input_file_name(), r"/asked/(\d+)/", 1).cast("long")
            newest = asked.select("qid", number.alias("_b")).groupBy("qid").agg(F.max("_b").alias("_newest"))
            rows = rows.join(newest, F.col("sample_id") == F.col("qid")).where("batch = _newest").drop("qid", "_newest")
        return rows.drop("batch")
