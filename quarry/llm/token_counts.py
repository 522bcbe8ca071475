"""Token counts: lengths of the library's encodings, and nothing but lengths.

Each Arrow batch of texts is cut into calls of about ``batch_bytes`` bytes, so a call's
memory follows bytes and not rows; a text above ``split_bytes`` is cut at boundaries where
the encodings of the parts add up to the encoding of the whole.

Safe boundaries
  ``.model`` (sentencepiece, identity normaliser, dummy prefix): in front of one space that
  follows a character other than a space and has text behind it. No piece holds a word mark
  after another character, so no merge crosses; the space is dropped, and the dummy prefix
  of the next part stands for it. A model for which this doesn't hold is never cut.
  ``.json`` (tokenizers): never cut, since the pre-tokenizer decides what may cross.

Defined results: null text counts as empty (0 bytes, 0 tokens); every input row gives one
row, repeated rows included; a null id stays null; an empty table gives an empty result;
columns besides the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 1 << 20
SPLIT_BYTES = 1 << 16


def split_text(text: str, limit: int) -> list[str]:
    """Parts of about ``limit`` bytes whose sentencepiece encodings add up (module docstring)."""
    # a text's mean bytes a character turn the limit into characters
    limit = max(1, limit * len(text) // max(1, len(text.encode())))
    parts, at = [], 0
    while len(text) - at > limit:
        cut = text.find(" ", at + limit)
        while cut > 0 and (text[cut - 1] in " ▁"):
            cut = text.find(" ", cut + 1)
        if cut < 0 or cut + 1 >= len(text):
            break
        parts.append(text[at:cut])
        at = cut + 1
    parts.append(text[at:])
    return parts


@functools.lru_cache(maxsize=4)
def load_counter(path: str):
    """``(count(list of texts) -> list of lengths, may_split)`` for a vocabulary file."""
    if path.endswith(".model"):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        inner = any("▁" in sp.id_to_piece(i).lstrip("▁") for i in range(sp.get_piece_size()))
        same = all(sp.decode(sp.encode(t)) == t for t in ("ﬁ  　x  y", "é z"))
        dummy = sp.encode("a b", out_type=str)[0].startswith("▁") and len(sp.encode(" ")) == 1
        return (lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]), same and dummy and not inner
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return (lambda texts: [len(x) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]), False


def count_texts(texts: list[str], path: str, batch_bytes: int = BATCH_BYTES,
                split_bytes: int = SPLIT_BYTES) -> list[int]:
    count, may_split = load_counter(path)
    totals, parts, owners, held = [0] * len(texts), [], [], 0

    def flush():
        nonlocal held
        for i, n in zip(owners, count(parts)):
            totals[i] += n
        parts.clear()
        owners.clear()
        held = 0

    for i, text in enumerate(texts):
        for part in split_text(text, split_bytes) if may_split else [text]:
            if part:
                parts.append(part)
                owners.append(i)
                held += len(part.encode())
                if held >= batch_bytes:
                    flush()
    if parts:
        flush()
    return totals


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = 4096, batch_bytes: int = BATCH_BYTES, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """One row per input row: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit``."""
    id_field = docs.schema[id_col]

    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), pa.array(count_texts(texts, path, batch_bytes, split_bytes), pa.int64())],
                names=[id_col, "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("_text"), F.octet_length(text).cast("long").alias("n_bytes"))
    schema = f"`{id_col}` {id_field.dataType.simpleString()}, n_bytes long, n_tokens long"
    return rows.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
