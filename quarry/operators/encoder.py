"""Encoder hook: token ids -> vectors through a user-supplied batch function.

``encoder_hook`` wraps ``pyspark.ml.functions.predict_batch_udf``: rows are
padded to a fixed length (the encoder input layout ``CLS ids SEP``; the pad id
is ``-1`` because every id from 0 up is a real token here), shipped to the user's ``predict(batch[n, L]) -> [n, d]`` in Arrow
batches, and the output width is checked against ``dim``. No model ships
here; ``hashing_embedder`` is a deterministic stand-in for tests (signed
feature hashing of token ids, L2-normalised).
"""

from __future__ import annotations

from typing import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.arrays import pad_cut
from quarry.operators.assembly import encoder_inputs
from quarry.params import RAGGED_PAD_ID


def hashing_embedder(dim: int, pad_id: int = RAGGED_PAD_ID) -> Callable[[], Callable[[np.ndarray], np.ndarray]]:
    def make():
        def predict(ids: np.ndarray) -> np.ndarray:
            ids = ids.astype(np.int64)
            n = ids.shape[0]
            out = np.zeros((n, dim), dtype=np.float64)
            rows, cols = np.nonzero(ids != pad_id)
            t = ids[rows, cols]
            h = (t * 2654435761) % (1 << 32)
            np.add.at(out, (rows, h % dim), np.where((h >> 16) & 1, 1.0, -1.0))
            norm = np.linalg.norm(out, axis=1, keepdims=True)
            return (out / np.where(norm == 0, 1.0, norm)).astype(np.float32)
        return predict
    return make


def encoder_hook(ids: Column, make_predict_fn, dim: int, *, max_len: int, cls_id: int, sep_id: int,
                 batch_size: int = 1024, pad_id: int = RAGGED_PAD_ID) -> Column:
    """ARRAY<INT> token ids -> ARRAY<FLOAT> of width ``dim`` (checked in the plan)."""
    from pyspark.ml.functions import predict_batch_udf
    enc = encoder_inputs(F.slice(ids, 1, max_len - 2), cls_id, sep_id)
    fixed = pad_cut(enc["input_ids"], max_len, pad_id)
    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size,
                            input_tensor_shapes=[[max_len]])
    v = udf(fixed)
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.format_string(
        "encoder returned width %d, expected %d", F.size(v), F.lit(dim))))
