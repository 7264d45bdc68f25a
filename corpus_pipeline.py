"""Training-data pipeline over ``documents``: each stage is one of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parityflow.llm import bpe, jaccard, language, linededup, mixing
from parityflow.llm.queries import vocabulary_path
from parityflow.session import materialised


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain enough; the dictionaries come from rows outside the held-out fold."""
    model = language.fit(docs.filter(~language.held_out() & F.col("doc_id").isNotNull()))
    return language.identify(docs, model).filter(~F.col("rejected")).select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document holds; ``n_chars`` follows the text."""
    kept = linededup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id. Without words or id, rows stay.

    Rows that repeat both id and text are one document; a row that shares its id with another text stays.
    """
    groups = jaccard.jaccard_components(docs.select("doc_id", "text"))
    gone = groups.filter(F.col("component_id") < F.col("doc_id")).select(F.col("doc_id").alias("__gone")).distinct()
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # the rank limit applies in every task before rows move
    same = [F.col("doc_id"), F.sha2(F.col("text").cast("binary"), 256)]
    turn = F.row_number().over(Window.partitionBy(*same).orderBy(F.xxhash64(*docs.columns)))
    ranked = docs.withColumn("__turn", F.when(F.col("doc_id").isNotNull() & has_words, turn).otherwise(1)).filter("__turn = 1")
    return ranked.join(gone, has_words & (F.col("doc_id") == F.col("__gone")), "left_anti").select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids and the text that these decode to."""
    vocabulary = bpe.read_vocabulary(vocabulary_path())
    return bpe.round_trip(docs, vocabulary, bpe.build_lexicon(docs, vocabulary))


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode_tokens),
]

ORACLE_SQL = None  # compression and merging cannot be said in SQL; tests/llm hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each writes its rows to the shared folder, which the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
