"""The corpus pipeline: quality filter, exact dedup, near-duplicate removal, benchmark decontamination, tokenising.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept, which is written as Parquet and read again in
between. All but the last return the columns of documents. Rows with a null doc_id pass the stages that name documents by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.llm import byte_bpe, decontaminate, exact_dedup, quality, simhash
from vecloom.llm.kernel import checkpointed, documents, staged

#: Identifiers that are broadcast at most (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000

#: Benchmark items of fewer words are common phrases: documents that hold one are kept.
LEAST_WORDS = 5

#: No SQL expresses the classifier, the edit-distance search or the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows that ``dropped`` names by its columns."""
    dropped = checkpointed(dropped.distinct())
    small = dropped.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(dropped) if small else dropped, dropped.columns, "left_anti").select(docs.columns)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the classifier's threshold."""
    return quality.keep_good(docs, quality.train(docs, documents(spark, sf_dir, "labels")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal normalised texts the row with the smallest doc_id, once."""
    groups = checkpointed(exact_dedup.exact_groups(docs))
    dropped = groups.where("NOT kept").select("doc_id").distinct()
    twice = checkpointed(groups.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if twice.isEmpty():
        return _without(docs, dropped)
    # a repeated doc_id doesn't name a row: its rows are judged by their text as well, and equal ones are kept once
    marked = docs.withColumn("__sha", F.sha2(exact_dedup.normalised("text"), 256))
    rest = _without(marked, groups.where("NOT kept").select("doc_id", F.col("text_sha256").alias("__sha")))
    once = rest.join(twice, "doc_id", "left_semi").withColumn("__n", F.row_number().over(Window.partitionBy("doc_id", "__sha").orderBy("text"))).where("__n = 1")
    return rest.join(twice, "doc_id", "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (narrow fingerprints, or five-word shingle sets of a similarity of 0.8), the one with the smallest doc_id."""
    return _without(docs, simhash.near_copies(docs).where("doc_id <> component_id").select("doc_id"))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item of LEAST_WORDS words or more."""
    return _without(docs, decontaminate.leaks(docs, documents(spark, sf_dir, "benchmark"), least_words=LEAST_WORDS).select("doc_id"))


def byte_bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and the digests of ids and decoded bytes."""
    import public_tokenizers

    return byte_bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, store=("ids",))


STAGES = [
    ("quality_classifier", quality_filter),
    ("exact_dedup", exact_dedup_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontaminate_stage),
    ("byte_bpe", byte_bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what lies between them is kept in the session's shared checkpoint folder."""
    docs = documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = staged(docs, name)
    return docs
