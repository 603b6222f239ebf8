"""Corpus pipeline: documents -> packed training sequences, stage by stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and read again as the
next stage's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringwise.llm.arrow import small_batches
from ringwise.llm.decontaminate import decontaminate
from ringwise.llm.language_id import identify
from ringwise.llm.ngram_join import drop_near_copies
from ringwise.llm.packing import pack
from ringwise.llm.quality import keep_good
from ringwise.llm.queries import TOKENIZER, VOCABULARY, public_file, table
from ringwise.session import stored

#: Least posterior of the predicted language for a document to stay.
LEAST_SCORE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: base rules and the likelihood ratio; rejected documents go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a recognisable language (``und``, or a low posterior) go."""
    rows = docs.select("doc_id", "text", "lang", F.struct("*").alias("_l_row"))
    out = identify(rows, public_file(VOCABULARY), keep=["_l_row"])
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select("_l_row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join (five words, 0.8): one document of each group of near copies stays."""
    return drop_near_copies(docs, n=5, threshold=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: passages are cut out, mostly copied documents go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: pieces of all documents in sequences of at most 4096 tokens."""
    return pack(docs, public_file(TOKENIZER), capacity=4096, end_id=2)


def sized(stage):
    """The stage with Arrow batches bounded for whole texts."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return stage(spark, docs, sf_dir)
    return run


STAGES = [("quality rules", sized(quality)), ("language ID", sized(language)), ("n-gram Jaccard join", sized(near_copies)),
          ("benchmark decontamination", sized(benchmark)), ("packing", sized(packing))]

#: Piece probabilities, suffix automaton and tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table; the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
