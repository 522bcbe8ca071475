"""A cache written from its parts holds the rows of the whole one; passages are moved once and looked up by hashing."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from quarry.operators.vocab import Vocab, build_vocab
from quarry.plans import queries as Q
from quarry.session import scratch_path, ship_package
from quarry.sources import parts as CP
from quarry.sources import versions as V
from quarry.sources.cache_io import sink_cache
from quarry.sources.padded import PaddedCache, dense, shards, sink_padded_parts

COLUMNS = ["split", "sample_id", "question_ids", "answer_ids", "retrievals"]


@pytest.fixture(scope="module")
def parts(spark):
    ship_package(spark)
    spark.dataSource.register(PaddedCache)
    ids = [*range(40), 7, 7, 200]                     # a repeated id, and a question without hits
    fields = [(None if i == 11 else ("eval", "test", "train")[i % 3], None if i == 12 else i, list(range(i % 5)),
               None if i % 3 == 1 else [i] * (i % 4)) for i in ids]
    hits = [(i, r + 1, (i * 7 + r * 5) % 23, 1.0 - r / 10) for i in range(40) for r in range(4)]
    tokens = [(b, list(range(b % 6))) for b in [*range(22), 3]]      # block 3 twice, block 22 nowhere
    return CP.CacheParts(spark.createDataFrame(fields, "split string, sample_id long, question_ids array<int>, answer_ids array<int>"),
                         spark.createDataFrame(hits, "sample_id long, rank long, block_id long, score double"),
                         spark.createDataFrame(tokens, "block_id long, token_ids array<int>"), len(hits))


def rows(df):
    return sorted(repr([r[c] for c in COLUMNS]) for r in df.select(COLUMNS).collect())


@pytest.mark.parametrize("broadcast", [True, False])
def test_the_same_rows_as_the_whole_cache(spark, parts, broadcast, monkeypatch):
    monkeypatch.setattr(CP, "ROWS_PER_FILE", 4)
    if not broadcast:
        monkeypatch.setattr("quarry.operators.retrieval.MAX_BROADCAST_HIT_BYTES", 0)
    want = spark.read.parquet(sink_cache(parts.whole(), scratch_path(spark, "whole"), 3))
    path = CP.sink_parts(parts, scratch_path(spark, "parts"), 3)
    got = spark.read.parquet(path)
    assert rows(got) == rows(want) and got.count() > 43
    per_shard = lambda df: sorted(tuple(r) for r in df.groupBy("split", "shard").count().collect())
    assert per_shard(got) == per_shard(want)
    assert max(r["n"] for r in got.groupBy(F.input_file_name()).agg(F.count(F.lit(1)).alias("n")).collect()) <= 4   # what a reader holds


def test_a_passage_is_moved_once(spark, parts):
    plan = CP.dealt(parts, 3)._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    heavy = [line for line in plan.splitlines() if "Exchange hashpartitioning(split" in line and "_file" in line]
    assert len(heavy) == 1 and "SortMergeJoin [split" not in plan


def test_versions_from_parts(spark, parts, tmp_path):
    root = str(tmp_path / "v")
    kept = parts.stored()
    assert V.write_version(kept, root, "a", ["train"], 3) == ["train"]
    assert V.write_version(kept, root, "a", ["train", "eval", "test"], 3) == ["eval", "test"]
    V.publish(spark, root, "a", ["train", "eval", "test"])
    want = spark.read.parquet(sink_cache(parts.whole(), scratch_path(spark, "whole"), 3))
    assert rows(V.read_version(spark, root, verify=True)) == rows(want)


def test_padded_from_parts(spark, parts):
    path = sink_padded_parts(parts, scratch_path(spark, "padded"), 3)
    whole = spark.read.parquet(sink_cache(parts.whole(), scratch_path(spark, "whole"), 3))
    ragged = whole.select("split", "sample_id", "question_ids", "answer_ids", F.transform("retrievals", lambda r: r["block_id"]).alias("block_ids"),
                          F.transform("retrievals", lambda r: r["token_ids"]).alias("passages"))
    key = lambda df: sorted(repr(list(r)) for r in df.select("split", "sample_id", "question_ids", "answer_ids", "block_ids", "passages").collect())
    assert key(spark.read.parquet(path)) == key(dense(ragged))               # the same pads
    back = spark.read.format("padded_cache").load(path)
    assert back.where("split = 'train'").count() == whole.where("split = 'train'").count()
    assert {s.split for s in shards(path)} == {"eval", "test", "train"}


def test_a_large_vocabulary_is_searched_by_hashing(spark):
    docs = spark.createDataFrame([(1, "b a b zz"), (2, None), (3, ""), (4, "a c")], "id long, text string")
    seen = Vocab(build_vocab(docs.where("id <> 4")), max_bytes=0)
    df = seen.encode_into(docs.withColumn("more", F.lit("zz a none")), {"x": "text", "y": "more"}, 3, drop=("more",))
    assert "map_from_entries" not in df._jdf.queryExecution().optimizedPlan().toString()   # its look-ups go entry by entry
    assert df.columns == ["id", "text", "x", "y"]
    ids = {r.token: r.token_id for r in seen.df.collect()}
    got = {r.id: r for r in df.collect()}
    assert got[1].x == [ids["b"], ids["a"], ids["b"]] and got[1].y == [ids["zz"], ids["a"], 0]
    assert got[2].x is None and got[3].x == [] and got[4].x == [ids["a"], 0]


def test_both_queries_write_from_parts(spark, monkeypatch):
    seen = []
    real = CP.dealt
    monkeypatch.setattr(CP, "dealt", lambda p, *a: seen.append(1) or real(p, *a))
    monkeypatch.setattr(Q.P, "retrieval_cache", None)
    sf = SF_SMALL
    assert sorted(map(repr, Q.QUERIES["cache_version"](spark, sf).collect())) == sorted(map(repr, Q.QUERIES["src_padded_cache"](spark, sf).collect()))
    assert len(seen) == 4
