"""Resumable stages: new input files since the last run, each worked on once.

A file stream with ``availableNow`` takes what has come since the checkpoint, in micro-
batches; each batch is written before it is committed, and keys that are in the output
already are left out, so a batch that is run again after a crash adds nothing twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import scratch, stored
from ..operators.joins import pending
from ..sources.jsonl import exists


def run_available(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], key: str, output: str, checkpoint: str, files_per_batch: int = 100) -> None:
    """Apply ``work`` to the records of all new JSON files under ``source`` and append the results."""

    def write(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        rows = batch.dropDuplicates([key])
        if exists(session, output):
            rows = pending(rows, session.read.parquet(output), key)
        work(rows).write.mode("append").parquet(output)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def merge_ordered(batch: DataFrame, path: str, key: str, seq: str = "seq", per_bucket: int = 100_000) -> None:
    """Add records to an output that stands in order of ``seq``, each key of a place once.

    The output is a folder for each ``per_bucket`` numbers, one sorted file in each, so reading
    folder by folder gives the input order without a sort. Only folders that the batch touches are
    read and written. A record that is there stays; of new ones with the same key and number the
    smallest counts (as JSON), so a run that is repeated writes the same. Keys are compared
    within a folder: a record keeps its number for good. Null numbers stand first.
    """
    spark = batch.sparkSession
    schema = batch.schema
    bucket = F.coalesce(F.floor(F.col(seq) / per_bucket), F.lit(-1)).cast("long")
    with scratch(spark):
        new = stored(batch.withColumn("bucket", bucket).withColumn("_new", F.lit(1)))
        touched = new.select("bucket").distinct()
        if exists(spark, path):
            there = spark.read.schema(schema.add("bucket", "long")).parquet(path)
            numbers = [r.bucket for r in touched.collect()]  # one for each folder that is written
            new = new.unionByName(there.where(F.col("bucket").isin(numbers)).withColumn("_new", F.lit(0)))
        turn = F.row_number().over(Window.partitionBy("bucket", key, seq).orderBy("_new", F.to_json(F.struct(*sorted(batch.columns)))))
        merged = new.withColumn("_turn", turn).where("_turn = 1").drop("_turn", "_new")
        kept = stored(merged)  # what is read must not be what is written
        dealt = kept.repartition("bucket").sortWithinPartitions("bucket", seq, key)
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def read_ordered(spark: SparkSession, path: str, seq: str = "seq", start: int | None = None, end: int | None = None, per_bucket: int = 100_000) -> DataFrame:
    """The records of such an output with ``start`` <= seq < ``end``; only their folders are read."""
    rows = spark.read.parquet(path)
    if start is not None:
        rows = rows.where((F.col("bucket") >= start // per_bucket) & (F.col(seq) >= start))
    if end is not None:
        rows = rows.where((F.col("bucket") <= (end - 1) // per_bucket) & (F.col(seq) < end))
    return rows.drop("bucket")


def run_ordered(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], key: str, output: str, checkpoint: str, seq: str = "seq", per_bucket: int = 100_000, files_per_batch: int = 100) -> None:
    """Like ``run_available``, with an output in order of ``seq``; a batch reads no more of it than it touches.

    ``work`` keeps ``seq`` and the key and gives the same rows for the same records; a batch that
    is run again after a crash changes nothing.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    write = lambda batch, _: merge_ordered(work(batch), output, key, seq, per_bucket)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
