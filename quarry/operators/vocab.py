"""Vocabulary: build, encode (token -> id) and decode (id -> token).

The vocabulary holds every distinct token of the corpus, ordered by (count desc, token asc);
ids follow the reserved ones (``params.SPECIALS``), and a token outside of it has the OOV id.
Building is a distributed count with map-side partial aggregation (a hot token never lands
in one task) and a range-partitioned numbering, written once. While its tokens are below
``MAX_VOCAB_BYTES`` they ship with an Arrow-batched function that does a vectorised hash lookup,
so token streams are neither exploded nor shuffled; beyond, ``encode_into`` / ``decode_into`` join the
distinct tokens of a row with the vocabulary table. Both give the same ids.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import TOKENIZERS
from quarry.operators.ranks import global_rank
from quarry.params import FIRST_TOKEN_ID, special_ids
from quarry.session import scratch_path

MAX_VOCAB_BYTES = 8 << 20   # of text: each Python task holds the tokens and a hash table, more than ten times as much
OOV = special_ids()["oov"]


def build_vocab(texts: DataFrame, text_col: str = "text", tokenizer: str = "whitespace") -> DataFrame:
    """``token, token_id, cnt`` for every distinct token of ``tokenizer`` (a name of ``TOKENIZERS``)."""
    counts = (texts.select(F.explode(TOKENIZERS[tokenizer](F.col(text_col))).alias("token"))
              .groupBy("token").agg(F.count(F.lit(1)).alias("cnt")))
    ranked = global_rank(counts, [F.desc("cnt"), F.asc("token")], "token_id")
    return ranked.select("token", (F.col("token_id") + FIRST_TOKEN_ID).cast("int").alias("token_id"), "cnt")


class Vocab:
    """A vocabulary ``token, token_id`` (built or given) with functions for columns and tables; texts are cut by ``tokenizer``."""

    def __init__(self, vocab_df: DataFrame, max_bytes: int = MAX_VOCAB_BYTES, tokenizer: str = "whitespace"):
        self.tokenize = TOKENIZERS[tokenizer]
        path = scratch_path(vocab_df.sparkSession, "vocab-table")
        vocab_df.write.parquet(path)
        self.df = vocab_df.sparkSession.read.schema(vocab_df.schema).parquet(path)
        n, low, high, nbytes = self.df.agg(F.count(F.lit(1)), F.min("token_id"), F.max("token_id"),
                                           F.sum(F.octet_length("token"))).first()
        if n and (low, high) != (FIRST_TOKEN_ID, FIRST_TOKEN_ID + n - 1):
            raise ValueError(f"vocabulary ids must be {FIRST_TOKEN_ID}..{FIRST_TOKEN_ID + n - 1}")
        self.size = n
        self.tokens = None
        if (nbytes or 0) <= max_bytes:  # checked before anything is gathered
            self.tokens = self.df.select("token", "token_id").orderBy("token_id").toArrow().column("token").to_pylist()
            self._encode = _make_encoder(self.tokens)
            self._decode = _make_decoder(self.tokens)

    def _small(self):
        if self.tokens is None:
            raise ValueError("the vocabulary is too large to ship with a column function: use encode_into / decode_into")

    def encode_tokens(self, toks: Column) -> Column:
        """ARRAY<STRING> -> ARRAY<INT>; unknown -> OOV id."""
        self._small()
        return self._encode(toks)

    def encode(self, text: Column, max_len: int | None = None) -> Column:
        """Text -> ids of its whole token stream, optionally truncated (truncate_field)."""
        toks = self.tokenize(text)
        return self.encode_tokens(F.slice(toks, 1, max_len) if max_len else toks)

    def decode(self, ids: Column) -> Column:
        """ARRAY<INT> -> space-joined tokens; ids outside the vocabulary render as ``<< id >>``."""
        self._small()
        return self._decode(ids)

    def encode_into(self, df: DataFrame, fields: dict, max_len: int | None = None, drop=()) -> DataFrame:
        """``df`` without ``drop`` and with ``fields`` (new column -> text column) encoded, whatever the vocabulary's size."""
        if self.tokens is not None:
            for out, text in fields.items():
                df = df.withColumn(out, self.encode(F.col(text), max_len))
            return df.drop(*drop)
        cut = {out: self.tokenize(F.col(text)) for out, text in fields.items()}
        return self._joined(df, {out: F.slice(t, 1, max_len) if max_len else t for out, t in cut.items()}, "token", "token_id",
                            _lookup("int", OOV), drop)

    def decode_into(self, df: DataFrame, fields: dict) -> DataFrame:
        """``df`` with ``fields`` (new column -> id column) decoded, whatever the vocabulary's size."""
        for out, ids in fields.items():
            if self.tokens is not None:
                df = df.withColumn(out, self.decode(F.col(ids)))
            else:
                df = self._joined(df, {out: F.col(ids)}, "token_id", "token", _lookup("string"))
                words = F.transform(F.arrays_zip(F.col(out).alias("w"), F.col(ids).alias("i")),
                                    lambda p: F.coalesce(p["w"], F.concat(F.lit("<< "), p["i"].cast("string"), F.lit(" >>"))))
                df = df.withColumn(out, F.array_join(words, " "))
        return df

    def _joined(self, df: DataFrame, items: dict, key: str, value: str, look, drop=()) -> DataFrame:
        """Looks the items of arrays (new column -> array) up in the vocabulary table: a row's distinct items, those of all
        arrays together, are joined by an equi join (a frequent item's rows can be split) and gathered back into a list
        per row. ``look`` maps the arrays a batch at a time by hashing; a map in the row would be searched entry by entry."""
        path, names = scratch_path(df.sparkSession, "rows"), [f"_items{i}" for i in range(len(items))]
        rest = [F.col(f"`{c}`") for c in df.columns if c not in drop and c not in items]
        df.select(*rest, *[a.alias(n) for a, n in zip(items.values(), names)], F.monotonically_increasing_id().alias("_row")).write.parquet(path)
        rows = df.sparkSession.read.parquet(path)
        every = F.array_distinct(F.flatten(F.array_compact(F.array(*names))))
        found = (rows.select("_row", F.explode(every).alias(key)).join(self.df.select(key, value), key)
                 .groupBy("_row").agg(F.collect_list(F.struct(key, value)).alias("_found")))
        rows = rows.join(found, "_row", "left")
        mapped = [look(F.col(n), F.col("_found")[key], F.col("_found")[value]).alias(out) for out, n in zip(items, names)]
        return rows.select(*rest, *mapped)


def _lookup(kind: str, fill=None):
    """Items -> values by a list of keys and one of values per row; a key has the same value in all rows."""
    @F.arrow_udf(f"array<{kind}>")
    def look(items: pa.Array, keys: pa.Array, values: pa.Array) -> pa.Array:
        items, keys, values = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (items, keys, values))
        flat = pc.list_flatten(items)
        at = pc.index_in(flat, value_set=pc.list_flatten(keys).cast(flat.type))
        found = pc.list_flatten(values).take(at)
        return _rebuild(items, found if fill is None else pc.fill_null(found, fill))

    return look


def _rebuild(lists: pa.Array, values: pa.Array) -> pa.Array:
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    import numpy as np
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=lists.is_null())


def _make_encoder(toks: list[str]):
    value_set = pa.array(toks, type=pa.string())

    @F.arrow_udf("array<int>")
    def encode(col: pa.Array) -> pa.Array:
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        flat = pc.list_flatten(col)
        idx = pc.fill_null(pc.add(pc.index_in(flat, value_set=value_set), FIRST_TOKEN_ID), OOV).cast(pa.int32())
        return _rebuild(col, idx)

    return encode


def _make_decoder(toks: list[str]):
    vocab = pa.array(toks, type=pa.string())
    n = len(toks)

    @F.arrow_udf("string")
    def decode(col: pa.Array) -> pa.Array:
        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        flat = pc.subtract(pc.list_flatten(col).cast(pa.int64()), FIRST_TOKEN_ID)
        known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, n))
        safe = pc.if_else(known, flat, 0)
        words = pc.take(vocab, safe) if n else pa.nulls(len(flat), pa.string())
        unknown = pc.binary_join_element_wise("<< ", pc.cast(pc.add(flat, FIRST_TOKEN_ID), pa.string()), " >>", "")
        words = pc.if_else(known, words, unknown)
        return pc.binary_join(_rebuild(col, words), " ")

    return decode


def write_vocab_file(vocab_df: DataFrame, path: str) -> str:
    """One token per line in id order, in as many files as the range partitions have (ids start at the first line)."""
    vocab_df.repartitionByRange("token_id").sortWithinPartitions("token_id").select("token").write.mode("overwrite").text(path)
    return path


def read_vocab_file(spark, path: str) -> DataFrame:
    """Vocabulary file(s), one token per line -> ``token, token_id``; the id follows the line's place in file order.
    A line's place is its start in its file, which the reader gives as metadata, so nothing runs row by row."""
    lines = spark.read.text(path).select(F.col("value").alias("token"), F.col("_metadata.file_path").alias("_file"),
                                         F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    ranked = global_rank(lines, ["_file", "_block", "_at"], "token_id")
    return ranked.select("token", (F.col("token_id") + FIRST_TOKEN_ID).cast("int").alias("token_id"))
