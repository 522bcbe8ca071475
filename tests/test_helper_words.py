"""The query helper_words puts the words for question, contexts and answer into its samples."""

import pytest

from quarry.params import MASK_ID, special_ids
from quarry.plans import queries as Q
from quarry.session import scratch_path

SP = special_ids()


@pytest.fixture(scope="module")
def samples(spark):
    sf = scratch_path(spark, "helper-words")
    docs = [(i, " ".join(f"w{i}{j}" for j in range(3 + i % 4))) for i in range(12)]
    vectors = [(i, [float(i == j) + i / 100 for j in range(4)]) for i in range(12)]
    turns = [(c, t, "user" if t % 2 else "assistant", f"w{c}{t} of {c}") for c in range(10) for t in range(1, 5)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(f"{sf}/embeddings.parquet")
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{sf}/conversations.parquet")
    rows = Q.QUERIES["helper_words"](spark, sf).collect()
    assert len(rows) == 20
    return [(r.split, [int(x) for x in r.input_ids.split()], r.label_ids and [int(x) for x in r.label_ids.split()]) for r in rows]


def test_every_sample_has_its_helper_words(samples):
    for split, ids, labels in samples:
        assert ids[0] == SP["question"]
        assert ids.count(SP["context"]) == 5 and ids.count(SP["answer"]) == 1
        at = ids.index(SP["answer"])
        assert ids.index(SP["context"]) < at
        if split == "test":
            assert labels is None and ids[at + 1] == SP["eos"]
        else:
            assert labels[:at + 1] == [MASK_ID] * (at + 1) and labels[at + 1] == ids[at + 1] > SP["answer"]


def test_the_twin_has_them_too():
    assert f"[{SP['question']}]" in Q.ORACLE["helper_words"] and f"[{SP['answer']}]" in Q.ORACLE["helper_words"]
