"""Readers of JSON lines, JSON arrays and source files.

The order of lines has meaning to later steps: ``with_seq`` numbers rows over all files by
counts of their splits, without moving them to one task.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Folders that hold no source, by reader.
SKIPPED = ["node_modules", ".git", "dist", "build", "coverage", "vendor"]


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines; blank lines don't count, any bad one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system Spark reads."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def read_jsonl_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The same, but a missing file has no records."""
    return read_jsonl(spark, path, schema) if exists(spark, path) else spark.createDataFrame([], schema)


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def _placed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with file, split and place, splits with their file, number of rows and first place).

    Spark packs splits of several files, larger ones first, into a partition; so a row's place
    is told by its file, where its split begins, and its place among the split's rows. Rows
    that don't come straight from files are one file with a split for each partition.
    """
    row = F.monotonically_increasing_id()
    try:
        placed = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), row.alias("_at"))
    except AnalysisException:
        placed = df.select("*", F.lit("").alias("_file"), F.spark_partition_id().cast("long").alias("_split"), row.alias("_at"))
    return placed, placed.groupBy("_file", "_split").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))


def _by_part(file: Column) -> Column:
    """Orders files by their path; those that Spark wrote by the number of the part, however many digits it has."""
    part = r"^(.*/part-)(\d+)([^/]*)$"
    number = F.regexp_extract(file, part, 2)
    return F.when(number != "", F.concat(F.regexp_extract(file, part, 1), F.lpad(number, 20, "0"), F.regexp_extract(file, part, 3))).otherwise(file)


def with_seq(df: DataFrame, name: str = "seq") -> DataFrame:
    """Rows numbered from 0, in order of file (parts by their number), place in the file; others in their present order.

    Only the splits' counts (a row for each) are put in one order, not the rows. ``df`` must be
    the reader's own DataFrame, or it is taken as not coming from files.
    """
    placed, splits = _placed(df)
    before = F.sum("_n").over(Window.orderBy(_by_part(F.col("_file")), "_split").rowsBetween(Window.unboundedPreceding, -1))
    start = splits.select("_file", "_split", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_start"))
    return placed.join(start, ["_file", "_split"]).withColumn(name, F.col("_start") + F.col("_at")).drop("_file", "_split", "_at", "_start")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text): raw lines with their number from 1 in their file, CRLF tolerated.

    Blank lines are counted and left out. Files of any size are read in splits.
    """
    placed, splits = _placed(spark.read.option("lineSep", "\n").text(path))
    before = F.sum("_n").over(Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1))
    start = splits.select("_file", "_split", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_start"))
    lines = placed.join(start, ["_file", "_split"])
    return lines.select(F.col("_file").alias("path"), (F.col("_start") + F.col("_at") + 1).alias("line"), F.regexp_replace("value", "\r$", "").alias("text")).where(F.trim("text") != "")


def parse_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Lines with their ``record``, and ``error`` ("path:line: no JSON") where there is none."""
    bad = F.try_parse_json("text").isNull()
    where = F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit(": no JSON"))
    return lines.select("path", "line", "text", F.when(~bad, F.from_json("text", schema)).alias("record"), F.when(bad, where).alias("error"))


def read_chat_samples(lines: DataFrame) -> DataFrame:
    """Chat samples with an ``error`` for each row that must not be trained on, else null.

    Checks in order: JSON, an id, an id not seen on an earlier line, exactly one user and one
    assistant message with content, the three quality gates.
    """
    from ..functions.records import CHECKS
    from ..functions.text import strip

    kind = "sample_id string, messages array<struct<role:string,content:string>>, metadata struct<quality:struct<alignment:string,granularity_match:string,solvability:string>>"
    rows = parse_lines(lines, kind).withColumn("sample_id", F.col("record.sample_id"))
    first = rows.where("sample_id is not null").groupBy("sample_id").agg(F.min(F.struct("path", "line")).alias("first"))
    rows = rows.join(first, "sample_id", "left")
    at = F.concat(F.col("path"), F.lit(":"), F.col("line").cast("string"), F.lit(": "))
    m = F.col("record.messages")
    error = F.when(F.col("error").isNotNull(), F.col("error"))
    error = error.when(F.coalesce(F.col("sample_id"), F.lit("")) == "", F.concat(at, F.lit("no id")))
    error = error.when(F.struct("path", "line") != F.col("first"), F.concat(at, F.lit("id seen before")))
    error = error.when(F.coalesce(F.size(m), F.lit(0)) != 2, F.concat(at, F.lit("not one question and one answer")))
    for i, role in enumerate(("user", "assistant")):
        error = error.when(~F.get(m, F.lit(i))["role"].eqNullSafe(F.lit(role)), F.concat(at, F.lit(f"not from {role} in place {i}")))
        error = error.when(strip(F.coalesce(F.get(m, F.lit(i))["content"], F.lit(""))) == "", F.concat(at, F.lit(f"no text from {role}")))
    for gate in CHECKS:
        error = error.when(~F.col(f"record.metadata.quality.{gate}").eqNullSafe(F.lit("pass")), F.concat(at, F.lit(f"{gate} not passed")))
    return rows.select("path", "line", "sample_id", m.alias("messages"), error.alias("error"))


def relative_path(path: Column, root: str) -> Column:
    return F.regexp_replace(path, "^(file:)?/*" + root.strip("/").replace(".", r"\.") + "/", "")


def typescript_files(spark: SparkSession, root: str, purpose: str = "family") -> DataFrame:
    """(path, text, length) of TypeScript files under ``root``, paths relative to it.

    ``family`` skips declaration and test files; ``eligible`` also names with "config" and
    test or generated folders; ``extract`` also folders called generated, but not test
    folders. Skipped folders are judged below the root only.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.ts").load(root)
    rows = files.select(relative_path(F.col("path"), root).alias("path"), F.decode("content", "UTF-8").alias("text"), "length")
    return rows.where(keeps(F.col("path"), purpose))


def keeps(path: Column, purpose: str) -> Column:
    """Whether a reader of that purpose takes the file, by its relative path."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    skipped = [*SKIPPED, "generated"] if purpose == "extract" else SKIPPED
    ok = name.endswith(".ts") & ~name.rlike(r"\.(d|test|spec)\.ts$") & ~F.arrays_overlap(parts, F.array(*map(F.lit, skipped)))
    if purpose != "family":
        ok = ok & ~name.rlike("(?i)config")
    if purpose == "eligible":
        ok = ok & ~path.rlike(r"(^|/)(test|tests|__tests__|generated)(/|$)")
    return ok


def task_ids(spark: SparkSession, paths: list[str], pattern: str = r"\b(H\d{1,2}_[A-Z_]+)\b") -> DataFrame:
    """Distinct task ids that occur in source files."""
    text = spark.read.text(paths, wholetext=True)
    return text.select(F.explode(F.regexp_extract_all("value", F.lit(pattern), F.lit(1))).alias("task_id")).distinct()
