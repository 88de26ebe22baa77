"""Registered queries of the training-data operators: name to ``f(spark, sf_dir)``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import (
    audit,
    bpe,
    importance,
    line_dedup,
    lm_bloom,
    mih,
    mixing,
    quality,
    simhash,
    suffix_dedup,
    surrogates,
    url_cascade,
    warc,
)
from tillroll.llm.common import scratch

#: A page of fewer payload bytes than this is thin; its url goes on the blocklist.
THIN_PAGE_BYTES = 1000
#: Key of the surrogates; a deployment passes its own secret.
SURROGATE_KEY = "surrogates of the test corpus"
#: Rank file of the byte-level vocabulary that texts are encoded with.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.score(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                         "n_repeat_words", "base_failed", "kept")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.pseudonymize(docs, SURROGATE_KEY).select("doc_id", "n_replaced", "text")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"),
                        "component_id")


def op6_lm_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_bloom.score(docs, held_out)


def token_digests(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    """Digests of the ids of every text and of the text decoded from them, and the ids if wanted."""
    path = public_tokenizers.path(VOCABULARY)
    both = bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"),
                       *(["ids"] if with_ids else []))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    warc.write_archives(warc.mark_revisits(
        _table(spark, sf_dir, "pages").select("page_id", "url", "html")), path)
    return warc.resolve(warc.read_records(spark, path)).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_mih_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.nearest(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"),
                       F.col("vec_id") % 20 == 0, k=20)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    thin = pages.filter(F.coalesce(F.octet_length("html"), F.lit(0)) < THIN_PAGE_BYTES)
    blocked = thin.select(url_cascade.url_key(F.col("url")).alias("key")).distinct()
    return url_cascade.judge(pages.select("page_id", "url"), blocked).select(
        "page_id", "host", "path", "rule", "verdict")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(_table(spark, sf_dir, "documents").select("doc_id", "text"),
                                _table(spark, sf_dir, "benchmark").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.dedup_bytes(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans",
                      F.sha2("kept", 256).alias("kept_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"),
                       _table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_source_mixing": op2_source_mixing,
    "op3_pii_surrogates": op3_pii_surrogates,
    "op4_line_dedup": op4_line_dedup,
    "op5_simhash_groups": op5_simhash_groups,
    "op6_lm_bloom": op6_lm_bloom,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_warc_salvage": op8_warc_salvage,
    "op9_mih_neighbours": op9_mih_neighbours,
    "op10_url_filter": op10_url_filter,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_filter_audit": op13_filter_audit,
}
