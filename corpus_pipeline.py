"""The corpus pipeline: documents in, packed token rows out.

Every stage reads all that its predecessor kept and, but for the last, returns the columns of documents, whatever
others there are and whatever they are called. Stages judge whole texts, however long; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.llm import decontaminate, language_id, mixing, ngram_join, packing

#: A text is rejected whose best language has less than this mean probability, or which has no letters.
LEAST_LANGUAGE_SCORE = 0.3
#: Words of a shingle and least Jaccard similarity in percent of near copies.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach, of all others none: not null or empty texts, nor such without letters.

    Repeated rows and rows without doc_id are judged by their text alone; equally likely languages score alike.
    """
    net = language_id.train(docs.select("doc_id", "text", "lang"))
    found = language_id.identify(docs.select(F.struct("*").alias("row"), "text"), net)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of least doc_id from each class of near copies, nulls last; of repeated rows one. Rows without words all stay."""
    return ngram_join.keep_one(docs, NEAR_WORDS, NEAR_PERCENT)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark window; null and empty texts hold none, and repeated rows are judged alike."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as its source's target asks; a null source is one, null texts count no words, repeated rows draw alike."""
    return mixing.mix(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed id matrices: every token of every text once, repeated rows each; null texts give none."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_benchmark),
    ("mixing_sources", mix_sources),
    ("token_packing", pack_tokens),
]
#: A trained network, a tokenizer and packing are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    from quillmap.llm.store import stash

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
