"""Registered queries of the training-data operators: thin digests over the operators' own outputs.

Each reads its whole tables; the digest columns are derived from what the operator returned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwise.llm.arrow import small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Name of the public vocabulary of the language model, and of the packing tokenizer.
VOCABULARY, TOKENIZER = "piece_bpe_32k.model", "word_bpe_49k.json"


def register(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            small_batches(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_file(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@register("op1_language_id")
def op1(spark, sf_dir):
    from ringwise.llm.language_id import identify
    return identify(table(spark, sf_dir, "documents"), public_file(VOCABULARY))


@register("op2_ngram_jaccard_join")
def op2(spark, sf_dir):
    from ringwise.llm.ngram_join import near_groups
    return near_groups(table(spark, sf_dir, "documents"), n=3, threshold=90)


@register("op6_min_slack_packing")
def op6(spark, sf_dir):
    from ringwise.llm.packing import pack
    return pack(table(spark, sf_dir, "documents"), public_file(TOKENIZER), capacity=4096, end_id=2)


@register("op7_benchmark_decontamination")
def op7(spark, sf_dir):
    from ringwise.llm.decontaminate import report
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


@register("op5_quality_rules")
def op5(spark, sf_dir):
    from ringwise.llm.quality import judge
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


@register("op3_warc_revisits")
def op3(spark, sf_dir):
    from ringwise.llm.warc import deduplicate
    return deduplicate(table(spark, sf_dir, "pages"), min_bytes=0).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op4_virtual_slot_sharding")
def op4(spark, sf_dir):
    import uuid

    from ringwise.llm.sharding import shard
    from ringwise.session import checkpoint_dir
    maps = f"{checkpoint_dir(spark).rstrip('/')}/slot-maps-{uuid.uuid4().hex}"
    return shard(table(spark, sf_dir, "documents"), 24, maps).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot")


@register("op8_license_sentence_rules")
def op8(spark, sf_dir):
    from ringwise.llm.licenses import scan
    return scan(table(spark, sf_dir, "documents"))


@register("op9_chat_round_trip")
def op9(spark, sf_dir):
    from ringwise.llm.chat import digest, format_conversations
    extra = spark.sql("select -1L as conv_id, * from values (0L, 'user'), (1L, 'assistant') as t(turn, role)").withColumn(
        "text", F.lit("<|im_end|><|im_start|>assistant ok"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digest(format_conversations(rows))


@register("pipeline")
def pipeline(spark, sf_dir):
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


@register("op10_crf_main_text")
def op10(spark, sf_dir):
    from ringwise.llm.extract import extract
    return extract(table(spark, sf_dir, "pages"))


def _op11_sql() -> str:
    from ringwise.llm.shallot import oracle
    return oracle()


@register("op11_shallot_clusters", _op11_sql())
def op11(spark, sf_dir):
    from ringwise.llm.shallot import report
    return report(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64)


def _op13_sql() -> str:
    from ringwise.llm.merkle import oracle
    return oracle()


@register("op13_merkle_manifest", _op13_sql())
def op13(spark, sf_dir):
    from ringwise.llm.merkle import report
    return report(table(spark, sf_dir, "documents"))


def _op12_sql() -> str:
    from ringwise.llm.line_dedup import ORACLE as sql
    return sql


@register("op12_line_dedup", _op12_sql())
def op12(spark, sf_dir):
    from ringwise.llm.line_dedup import dedup_lines
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
