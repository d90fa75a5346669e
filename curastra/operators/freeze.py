"""Frozen releases: digests that bind a dataset, and their verification."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_digest(rows: DataFrame) -> Column:
    """Digest of a row as JSON with its nulls, columns in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)


#: Characters by which buckets of digests are folded: 4096 into one.
FOLD = 3


def dataset_digest(rows: DataFrame, per_bucket: int = 65_536) -> DataFrame:
    """One row: ``n`` and ``digest`` of the rows as a multiset, whatever their order.

    Row digests are sorted and hashed within buckets of their first characters: three, or as many
    threes as leave ``per_bucket`` rows to a bucket. Then 4096 buckets at a time are folded to the
    digest of their digests in order, until one is left. So no task holds more than a bucket or a
    fold, and the digest depends on the rows and their number only.
    """
    n, width = rows.count(), FOLD
    while n > per_bucket * 16**width:
        width += FOLD
    each = rows.select(row_digest(rows).alias("d")).withColumn("b", F.substring("d", 1, width))
    part = each.groupBy("b").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("d")), "\n"), 256).alias("d"))
    folded = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "\n"), 256)
    while width > FOLD:
        width -= FOLD
        part = part.groupBy(F.substring("b", 1, width).alias("to")).agg(F.sum("n").alias("n"), folded.alias("d")).withColumnRenamed("to", "b")
    return part.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), folded.alias("digest"))


#: Bytes read at a time, whatever a file's size.
PIECE = 1 << 20


def open_path(path: str):
    """A readable, seekable file on any file system pyarrow knows; tasks call it on the executors."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    system, name = fs.FileSystem.from_uri(quote(path, safe="/:@"))
    return system.open_input_file(name)


def files(spark, paths: list[str]) -> DataFrame:
    """(path, length) of files; their content isn't read.

    A scan leaves out empty files, so these are told from the list of files that Spark keeps.
    """
    read = spark.read.format("binaryFile").load(paths)
    found = read.select("path", "length")
    names = [(re.sub("^file:/+", "file:/", unquote(p)),) for p in read.inputFiles()]
    empty = spark.createDataFrame(names, "path string").join(found, "path", "left_anti")
    return found.unionByName(empty.withColumn("length", F.lit(0).cast("long")))


def _streamed(opener):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path, offset, length in zip(*(batch.column(k).to_pylist() for k in ("path", "offset", "length")), strict=True):
                digest, left = sha256(), length
                with opener(path) as file:
                    file.seek(offset)
                    while left > 0 and (piece := file.read(min(PIECE, left))):
                        digest.update(piece)
                        left -= len(piece)
                if left:
                    raise OSError(f"{path} ends {left} bytes early")
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, "sha256"])

    return run


def file_digests(spark, paths: list[str], opener=open_path) -> DataFrame:
    """(path, sha256) of whole files, by their bytes.

    A file is streamed in pieces, so it may be larger than a row or a task's memory; one task
    reads it from end to end, as the digest asks for. ``chunk_digests`` share a file out.
    """
    rows = files(spark, paths).select("path", F.lit(0).cast("long").alias("offset"), "length")
    spread = rows.repartition("path")
    return spread.mapInArrow(_streamed(opener), "path string, offset long, length long, sha256 string").select("path", "sha256")


def chunk_digests(spark, paths: list[str], chunk: int = 64 << 20, opener=open_path) -> DataFrame:
    """(path, chunk, offset, length, sha256) of fixed ranges of files, each read by itself.

    The last range of a file may be shorter; an empty file has one range of no bytes.
    """
    last = F.greatest(F.ceil(F.col("length") / chunk) - 1, F.lit(0)).cast("long")
    rows = files(spark, paths).select("path", F.col("length").alias("whole"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    rows = rows.select("path", "chunk", (F.col("chunk") * chunk).alias("offset"), F.least(F.lit(chunk), F.col("whole") - F.col("chunk") * chunk).cast("long").alias("length"))
    return rows.repartition("path", "chunk").mapInArrow(_streamed(opener), "path string, chunk long, offset long, length long, sha256 string")


def tree_digests(chunks: DataFrame, fanout: int = 256) -> DataFrame:
    """(path, n_chunks, root) from (path, chunk, sha256): digests of up to ``fanout`` digests, level by level.

    A level's groups have at most ``fanout`` rows and the table shrinks by that factor, so no task
    holds the chunks of a file. A path with one chunk has its digest as root. Chunks that are missing
    or doubled raise an error.
    """
    whole = chunks.groupBy("path").agg(F.count("*").alias("n"), F.countDistinct("chunk").alias("_distinct"), F.min("chunk").alias("_first"), F.max("chunk").alias("_last"))
    sound = (F.col("n") == F.col("_distinct")) & (F.col("_first") == 0) & (F.col("_last") == F.col("n") - 1)
    whole = whole.select("path", F.when(sound, F.col("n")).otherwise(F.raise_error(F.concat(F.lit("chunks of "), F.col("path"), F.lit(" aren't whole"))).cast("long")).alias("n"))
    most = whole.agg(F.max("n")).first()[0] or 0
    level = chunks.join(whole, "path").select("path", "n", F.col("n").alias("left"), F.col("chunk").alias("at"), F.col("sha256").alias("d"))
    while most > 1:
        children = F.array_sort(F.collect_list(F.struct("at", "d")))
        folded = F.sha2(F.array_join(F.transform(children, lambda x: x["d"]), "\n"), 256)
        level = level.groupBy("path", "n", "left", F.floor(F.col("at") / fanout).alias("to")).agg(F.when(F.col("left") > 1, folded).otherwise(F.min("d")).alias("d"))
        level = level.select("path", "n", F.ceil(F.col("left") / fanout).alias("left"), F.col("to").alias("at"), "d")
        most = -(-most // fanout)
    return level.select("path", F.col("n").alias("n_chunks"), F.col("d").alias("root"))


def changed_chunks(frozen: DataFrame, now: DataFrame) -> DataFrame:
    """(path, chunk, what) of chunks whose digests differ: ``changed``, ``missing`` or ``added``."""
    old, new = (df.select("path", "chunk", F.col("sha256").alias(k)) for df, k in ((frozen, "_old"), (now, "_new")))
    both = old.join(new, ["path", "chunk"], "full").where(~F.col("_old").eqNullSafe(F.col("_new")))
    return both.select("path", "chunk", F.when(F.col("_new").isNull(), "missing").when(F.col("_old").isNull(), "added").otherwise("changed").alias("what"))


def text_chunks(rows: DataFrame, key: str, text: str, chunk: int) -> DataFrame:
    """(path, chunk, sha256) of fixed byte ranges of a text column, as ``chunk_digests`` has them of files; null is empty."""
    data = rows.select(F.col(key).cast("string").alias("path"), F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8").alias("_data"))
    last = F.greatest(F.ceil(F.length("_data") / chunk) - 1, F.lit(0)).cast("int")
    each = data.select("path", F.posexplode(F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.substring(F.col("_data"), i * chunk + 1, F.lit(chunk)), 256))).alias("chunk", "sha256"))
    return each.select("path", F.col("chunk").cast("long").alias("chunk"), "sha256")


def manifest(samples: DataFrame, audits: DataFrame, files: DataFrame, name: str, family: Column, granularity: Column, category: Column, decision: Column) -> DataFrame:
    """One row that describes a release: counts, histograms, digests of its files."""
    hist = lambda c: samples.groupBy(c.alias("k")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias("m"))
    data = samples.agg(F.count("*").alias("samples"), F.countDistinct(family).alias("families"))
    audit = audits.agg(F.count("*").alias("reviewed"), F.count_if(decision == "accept").alias("audit_accepted"), F.count_if(decision == "reject").alias("audit_rejected"))
    bound = files.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", "sha256")))).alias("sha256"))
    parts = [data, audit, bound, hist(granularity).withColumnRenamed("m", "granularity"), hist(category).withColumnRenamed("m", "category")]
    out, *more = (p.withColumn("_one", F.lit(1)) for p in parts)  # each has one row
    for p in more:
        out = out.join(p, "_one")
    out = out.drop("_one")
    return out.select(F.lit("1.0").alias("schema_version"), F.lit(name).alias("freeze_name"), "*")


def mismatches(frozen: DataFrame, now: DataFrame, expected: dict[str, int] | None = None, found: dict[str, int] | None = None) -> DataFrame:
    """(what): files whose digest isn't the frozen one or that are missing, and counts that differ."""
    wrong = frozen.join(now, ["path", "sha256"], "left_anti").select(F.col("path").alias("what"))
    off = [(k,) for k, v in (expected or {}).items() if (found or {}).get(k) != v]
    return wrong.unionByName(frozen.sparkSession.createDataFrame(off, "what string")).distinct()


def verify(frozen: DataFrame, now: DataFrame, expected: dict[str, int] | None = None, found: dict[str, int] | None = None) -> None:
    """Fails with the sorted names of what has changed."""
    wrong = sorted(r.what for r in mismatches(frozen, now, expected, found).collect())
    if wrong:
        raise ValueError("frozen release mismatch: " + ", ".join(wrong))


def failed_requirements(freeze: DataFrame, **required: object) -> DataFrame:
    """(requirement): names of settings whose frozen value isn't the required one."""
    checks = F.array(*(F.struct(F.lit(k).alias("requirement"), F.col(k).cast("string").eqNullSafe(F.lit(None if v is None else str(v).lower() if isinstance(v, bool) else str(v))).alias("ok")) for k, v in required.items()))
    return freeze.select(F.inline(checks)).where("not ok").select("requirement")


def same_sets(left: DataFrame, right: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeats included."""
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()
