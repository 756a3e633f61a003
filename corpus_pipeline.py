"""A corpus pipeline: quality filter, exact deduplication, near-duplicate removal, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import dedup, jaccard, packing, quality
from callweave.llm.common import stage, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; all columns of docs stay."""
    labels = table(spark, sf_dir, "labels")
    return quality.score(docs, quality.fit(docs, labels), "__score").filter(F.col("__score") >= quality.CUT).drop("__score")


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with __row, a number of its own for every row, whatever its doc_id; staged, so that it stays."""
    return stage(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered", compression="zstd")


def _first_of(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The row of docs with the smallest doc_id of each group (rows of __row, group); a null doc_id is the largest."""
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("first")
    kept = groups.join(docs.select("__row", "doc_id"), "__row").groupBy("group").agg(first).select(F.col("first.__row").alias("__row"))
    return docs.join(kept, "__row", "left_semi").drop("__row")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts. Rows are told apart by number, as a doc_id may be null or repeated."""
    docs = _numbered(docs)
    got = dedup.exact_dedup(docs.select(F.col("__row").alias("doc_id"), "text"))
    return _first_of(docs, got.select(F.col("doc_id").alias("__row"), F.col("keep_id").alias("group")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links join; documents without words stay."""
    docs = _numbered(docs)
    got = jaccard.near_duplicates(docs.select(F.col("__row").alias("doc_id"), "text"))
    return _first_of(docs, got.select(F.col("doc_id").alias("__row"), F.col("component_id").alias("group")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in their sequences."""
    return packing.pack_documents(docs)


STAGES = [("quality classifier", keep_good), ("exact dedup", drop_copies), ("n-gram Jaccard join", drop_near_copies), ("best-fit packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
