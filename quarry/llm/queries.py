"""Registered queries of the training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

from quarry.llm import chat_format as CF
from quarry.llm import license_scan as LS
from quarry.llm import quality_rules as QR
from quarry.llm import structure_repair as SR
from quarry.llm import warc
from quarry.llm.common import table, tokenizer_path
from quarry.llm.decontaminate import leaks
from quarry.llm.embedding_whitening import whiten
from quarry.llm.language_id import identify
from quarry.llm.lm_scoring import lm_scores
from quarry.llm.ngram_join import ngram_join
from quarry.llm.packing import pack
from quarry.llm.suffix_dedup import suffix_dedup

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


@register("op10_token_counts")
def op10(spark, sf_dir):
    from quarry.llm.token_counts import token_counts
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


@register("op8_quality_rules", QR.oracle_sql())
def op8(spark, sf_dir):
    return QR.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op4_license_scan", LS.oracle_sql())
def op4(spark, sf_dir):
    return LS.license_scan(table(spark, sf_dir, "documents"))


@register("op5_chat_format", CF.oracle_sql())
def op5(spark, sf_dir):
    return CF.rotate(table(spark, sf_dir, "conversations"))


@register("op1_ngram_join")
def op1(spark, sf_dir):
    return ngram_join(table(spark, sf_dir, "documents"))


@register("op2_suffix_dedup")
def op2(spark, sf_dir):
    out = suffix_dedup(table(spark, sf_dir, "documents"), keep="none", columns=["doc_id"], with_text=False)
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@register("op9_packing")
def op9(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@register("op7_warc", warc.ORACLE)
def op7(spark, sf_dir):
    manifest = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op6_decontamination")
def op6(spark, sf_dir):
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op3_language_id")
def op3(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


@register("op13_embedding_whitening")
def op13(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))


@register("op11_structure_repair", SR.oracle_sql())
def op11(spark, sf_dir):
    return SR.structure_repair(table(spark, sf_dir, "conversations"))


@register("op12_lm_scoring")
def op12(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents"))
