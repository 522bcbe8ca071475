import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm.common import tokenizer_path
from quarry.llm.token_counts import count_texts, split_text, token_counts

MODEL = tokenizer_path("piece_bpe_32k.model")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=list("ab \n\té▁.<s>") + ["ﬁ", "　", "語"], max_size=60), st.integers(1, 9))
def test_split_adds_up(text, limit):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert " ".join(split_text(text, limit)) == text
    assert count_texts([text], MODEL, batch_bytes=7, split_bytes=limit) == [len(sp.encode(text))]


def test_edges(spark):
    long = "palabra de ciónque " * 40_000
    rows = [(1, None, 5), (2, "", 5), (None, "a b", 5), (3, "a b", 5), (3, "a b", 5), (4, long, 5), (5, "<s> hi </s>", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(df, MODEL).collect())
    want = sorted((str(i), len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096)
                  for i, t, _ in rows)
    assert got == want
    assert token_counts(df.limit(0), MODEL).collect() == []


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_json_vocabulary(spark, name):
    from tokenizers import Tokenizer
    path = tokenizer_path(name)
    texts = ["Hello  world\n<|endoftext|>", "", "ñ é 語"]
    tok = Tokenizer.from_file(path)
    want = [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    assert count_texts(texts, path) == want


def test_query_against_library(spark):
    import sentencepiece

    from quarry.llm.queries import QUERIES
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = QUERIES["op10_token_counts"](spark, d).collect()
    assert len(got) == len(texts)
    assert all(r.n_tokens == len(sp.encode(texts[r.doc_id])) for r in got)
