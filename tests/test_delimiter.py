"""Delimiter tokenizer: mixed scripts against a plain scan of characters and against SQL; vocabularies built with it."""

import json
import os
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from quarry import oracle as O
from quarry.functions.text import TOKENIZERS, delimiter_tokens
from quarry.operators.vocab import Vocab, build_vocab, write_vocab_file
from quarry.params import FIRST_TOKEN_ID
from quarry.session import scratch_path

from tests.conftest import SF_SMALL

TEXTS = ["Hello, world!", "  a  b\t\nc ", "", " \n", None, "naïve café—déjà vu…", "东京2020年，日本。", "ab\U00020000cd\U0002A6DFe", "\U0002F800x",
         "x_y-z", "[a]`b`{c}~|", "a b", "a\x0bb", "¿Qué?", "«oui»", "1,000.50$", "\\d+^2", "don't", "한국어 テスト。", "\U0001F600:)", "a" * 50000 + "," + "b" * 50000,
         "㐀䶿豈", "A　B", "İstanbul"]
CJK = [(0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F), (0x2B820, 0x2CEAF), (0xF900, 0xFAFF), (0x2F800, 0x2FA1F)]


def plain(text):
    """One character at a time."""
    out, held = [], ""
    for c in text:
        ascii_mark = 33 <= ord(c) <= 126 and not c.isalnum()
        single = ascii_mark or unicodedata.category(c).startswith("P") or any(lo <= ord(c) <= hi for lo, hi in CJK)
        if single or c in "\t\n\f\r ":
            out += [held] if held else []
            held = ""
        if single:
            out.append(c)
        elif c not in "\t\n\f\r ":
            held += c
    return out + ([held] if held else [])


def frame(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i long, text string")


def test_against_a_scan_of_characters(spark):
    got = {r.i: r.t for r in frame(spark).select("i", delimiter_tokens(F.col("text"), lower=False).alias("t")).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i] == (None if text is None else plain(text)), text


def test_against_sql(spark):
    got = {r.i: r.t for r in frame(spark).where("i <> 23").select("i", delimiter_tokens(F.col("text")).alias("t")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE x (i BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO x VALUES (?, ?)", [r for r in enumerate(TEXTS) if r[0] != 23])
    assert got == dict(con.execute(f"SELECT i, {O.delimiter_tok('text')} FROM x").fetchall())


def test_vocabulary_round_trip(spark):
    texts = frame(spark).where("i < 20")
    df = build_vocab(texts, tokenizer="delimiter")
    counts: dict = {}
    for r in texts.select(delimiter_tokens(F.col("text")).alias("t")).collect():
        for t in r.t or []:
            counts[t] = counts.get(t, 0) + 1
    ranked = sorted(counts, key=lambda t: (-counts[t], t.encode()))
    assert [(r.token, r.token_id, r.cnt) for r in df.orderBy("token_id").collect()] == [
        (t, FIRST_TOKEN_ID + k, counts[t]) for k, t in enumerate(ranked)]
    ids = {t: FIRST_TOKEN_ID + k for k, t in enumerate(ranked)}
    want = {r.i: None if r.t is None else [ids[t] for t in r.t] for r in texts.select("i", delimiter_tokens(F.col("text")).alias("t")).collect()}
    for bound in (1 << 20, 0):   # by a column function, by a join
        voc = Vocab(df, max_bytes=bound, tokenizer="delimiter")
        got = {r.i: r.ids for r in voc.encode_into(texts, {"ids": "text"}).select("i", "ids").collect()}
        assert got == want
        back = {r.i: r.d for r in voc.decode_into(voc.encode_into(texts, {"ids": "text"}), {"d": "ids"}).select("i", "d").collect()}
        assert back[0] == "hello , world !"


def test_only_the_delimiter_tokenizer_cuts_marks(spark):
    row = spark.range(1).select(*[fn(F.lit("a,b c")).alias(name) for name, fn in TOKENIZERS.items()]).first()
    assert row.whitespace == ["a,b", "c"] and row.delimiter == ["a", ",", "b", "c"]
    with pytest.raises(KeyError):
        build_vocab(frame(spark), tokenizer="other")


def test_cache_job_with_a_given_vocabulary(spark):
    from quarry import jobs
    from quarry.plans import pipeline as P
    built = build_vocab(P.corpus_text(spark, SF_SMALL), tokenizer="delimiter").where(f"token_id < {FIRST_TOKEN_ID + 50}").select("token", "token_id")
    path = write_vocab_file(built, scratch_path(spark, "given-vocab"))
    out = scratch_path(spark, "given-cache")
    jobs.main(["cache", "--data", SF_SMALL, "--out", out, "--k", "2", "--shards", "2", "--vocab", path, "--tokenizer", "delimiter"])
    back = spark.read.parquet(os.path.join(out, "_vocab"))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in built.collect()}
    cache = spark.read.parquet(out)
    assert cache.count() > 0
    ids = json.loads(cache.select(F.to_json(F.array_distinct(F.flatten(F.collect_list("question_ids")))).alias("j")).first().j)
    assert max(ids) < FIRST_TOKEN_ID + 50
