"""Writers: JSON lines, accept and reject sinks, one-row reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import stored


def write_jsonl(df: DataFrame, path: str, keep_nulls: bool = True) -> None:
    """Replace a folder of JSON lines once all rows are written; a write that fails leaves it as it was.

    The rows go to a folder beside it, which then takes its name. A crash between the two
    renames leaves the former rows under ``<path>.former-...``.
    """
    spark = df.sparkSession
    tag = uuid.uuid4().hex
    to, new, former = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new-{tag}", f"{path}.former-{tag}"))
    files = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        df.write.option("ignoreNullFields", not keep_nulls).json(new.toString())
    except Exception:
        files.delete(new, True)
        raise
    there = files.exists(to)
    if there and not files.rename(to, former):
        raise OSError(f"can't move {path} away")
    if not files.rename(new, to):
        if there:
            files.rename(former, to)
        raise OSError(f"can't name the new rows {path}")
    if there:
        files.delete(former, True)


def split_write(df: DataFrame, accepted: Column, accepted_path: str, rejected_path: str) -> None:
    """Accepted and rejected rows of one computation, which is stored in between."""
    rows = stored(df.withColumn("_ok", accepted))
    write_jsonl(rows.where("_ok").drop("_ok"), accepted_path)
    write_jsonl(rows.where("not coalesce(_ok, false)").drop("_ok"), rejected_path)


def in_input_order(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Rows in the order of their numbers, for a checkpoint that is read by people."""
    return df.orderBy(seq)


def report(df: DataFrame) -> DataFrame:
    """A one-row DataFrame as one JSON string, ``report``."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false", "pretty": "true"}).alias("report"))
