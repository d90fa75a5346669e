"""From documents to packed training windows: four stages of the ``curastra.llm`` operators.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a
DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from curastra.llm.ngram_join import similar_groups
from curastra.llm.packing import pack
from curastra.llm.quality import classify, train
from curastra.llm.queries import tokenizer_path
from curastra.llm.suffix_dedup import dedup_passages

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go; trained on the ``labels`` of ``docs``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return classify(docs, train(docs, labels)).where("accepted").select(COLUMNS)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents alike to 0.8 in five-word shingles the smallest id stays, once."""
    groups = similar_groups(docs, words=5, percent=80)
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("first")).distinct()
    kept = docs.join(first, docs["doc_id"].eqNullSafe(first["first"]), "left_semi")
    again = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id"))  # repeated rows
    return kept.withColumn("again", again).where("again = 1").select(COLUMNS)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every string of 100 bytes stays where it starts first; all documents stay."""
    out = dedup_passages(docs, length=100)
    return out.withColumn("text", F.col("kept")).withColumn("n_chars", F.length("kept").cast("long")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 tokens, with their ids."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), capacity=2048, end_id=1)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("suffix_array_dedup", suffix_array_dedup),
    ("packing", packing),
]

#: SQL can't express the classifier, nor the packing; the tests have brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        out = stage(spark, out, sf_dir)
    return out
