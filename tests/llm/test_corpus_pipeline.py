import itertools
from collections import Counter

import corpus_pipeline as C
import test_decontaminate as TD
import test_ngram_join as TN
import test_packing as TP
import test_suffix_dedup as TS

D = "/root/testdata/sf0.001"


def spans_first(rows):
    """Texts with later copies of 200-byte strings removed, in the order of ids."""
    raws = {i: t.encode() for i, t in rows}
    seen, out = set(), {}
    for i in sorted(raws):
        raw, gone, new = raws[i], bytearray(len(raws[i])), []
        for x in range(len(raw) - TS.L + 1):
            w = raw[x:x + TS.L]
            if w in seen:
                gone[x:x + TS.L] = b"\x01" * TS.L
            else:
                seen.add(w)
        out[i] = bytes(itertools.compress(raw, (not g for g in gone))).decode("utf-8", "ignore")
    return out


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    columns = docs.columns
    one = C.quality(spark, docs, D)
    assert one.columns == columns
    import duckdb

    from quarry.llm.quality_rules import oracle_sql
    for t in ("documents", "labels"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    kept = Counter(r[0] for r in duckdb.sql(f"SELECT doc_id FROM ({oracle_sql()}) WHERE kept").fetchall())
    assert Counter(r.doc_id for r in one.collect()) == kept

    rows = sorted((r.doc_id, r.text) for r in one.collect())
    two = C.near_duplicates(spark, one, D)
    assert two.columns == columns
    assert sorted(r.doc_id for r in two.collect()) == sorted({int(c) for _, _, c in TN.brute(rows)})

    before = {r.doc_id: r for r in two.collect()}
    three = C.repeated_passages(spark, two, D)
    assert three.columns == columns
    want = {i: t for i, t in spans_first([(i, r.text) for i, r in before.items()]).items() if t.split()}
    got = {r.doc_id: r for r in three.collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for i, r in got.items() if r.text != before[i].text)

    four = C.benchmark_leaks(spark, three, D)
    assert four.columns == columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
    leaked = {i for i, _ in TD.brute(sorted(want.items()), items)}
    assert {r.doc_id for r in four.collect()} == set(want) - leaked

    TP.check([(r.doc_id, r.text) for r in four.collect()], C.packing(spark, four, D).collect())


def test_run_gives_the_stages_rows(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for _, f in C.STAGES:
        docs = f(spark, docs, D)
    assert sorted(map(str, C.run(spark, D).collect())) == sorted(map(str, docs.collect()))


def test_one_of_each_edges(spark):
    from quarry.llm.ngram_join import one_of_each
    rows = [(None, "a b c d e"), (None, "a b c d e"), (3, "a b c d e"), (3, "a b c d e"), (2, "A b c d e"), (5, None), (5, ""), (None, None),
            (None, "q r"), (None, "q r")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS key")
    out = one_of_each(df)
    assert out.columns == df.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == sorted(
        [("2", "A b c d e"), ("5", "None"), ("5", ""), ("None", "None"), ("None", "q r")])


def test_empty_table(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    for _, f in C.STAGES:
        docs = f(spark, docs, D)
    assert docs.collect() == []
