"""live_retrieve answers from the whole index, as exact search does."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from quarry.plans import queries as Q


def _tables(at):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(400, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    ids = list(range(400))
    pq.write_table(pa.table({"doc_id": ids, "text": [f"passage {i}" for i in ids]}), f"{at}/documents.parquet")
    pq.write_table(pa.table({"vec_id": ids, "embedding": pa.array([v.astype(np.float32).tolist() for v in vectors], pa.list_(pa.float32()))}),
                   f"{at}/embeddings.parquet")
    pq.write_table(pa.table({"conv_id": list(range(12)), "turn": [0] * 12, "role": ["user"] * 12, "text": ["asked"] * 12}),
                   f"{at}/conversations.parquet")
    return vectors.astype(np.float32).astype(np.float64)


def test_no_leaf_is_left_out(spark, tmp_path):
    v = _tables(tmp_path)
    found: dict = {}
    for r in Q.QUERIES["live_retrieve"](spark, str(tmp_path)).collect():
        found.setdefault(r["sample_id"], {})[r["rank"]] = (r["block_id"], r["text"])
    assert len(found) == 12
    for sample, hits in found.items():
        best = np.argsort(-(v @ v[sample % 400]), kind="stable")[:10].tolist()
        assert [hits[i + 1] for i in range(10)] == [(b, f"passage {b}") for b in best]
    assert "hits" in Q.ORACLE["live_retrieve"] and "leaves_of" not in Q.ORACLE["live_retrieve"]
