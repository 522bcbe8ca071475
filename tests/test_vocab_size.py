"""Queries on encoded fields give the same rows whatever the vocabulary's size."""

import pytest

from quarry.operators.vocab import Vocab
from quarry.plans import queries as Q

from tests.conftest import SF_SMALL

NAMES = ["truncate_field", "strip_padding", "encoder_inputs", "sink_generations", "encoder_hook", "encoder_batch_pad"]


@pytest.mark.parametrize("name", NAMES)
def test_vocabulary_beyond_the_bound(spark, monkeypatch, name):
    small = sorted(map(repr, Q.QUERIES[name](spark, SF_SMALL).collect()))
    voc = Q.vocab_for(spark, SF_SMALL)
    large = Vocab(voc.df.select("token", "token_id"), max_bytes=0)
    assert voc.tokens is not None and large.tokens is None
    monkeypatch.setattr(Q, "vocab_for", lambda *a: large)
    assert sorted(map(repr, Q.QUERIES[name](spark, SF_SMALL).collect())) == small and small
