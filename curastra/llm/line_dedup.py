"""Lines that many documents share stay in the last of them only.

A line's key is the line without blanks at its ends, A-Z in lower case; it travels as a
128-bit hash. ``Runs`` is an index of keys in levelled sorted runs: each run is a table
bucketed and sorted by hash, so that batches meet runs bucket by bucket and no run is ever
shuffled again. A new batch is merge-anti-joined with the runs: keys that are known well
enough are left out, the rest become a new run on the lowest level. Once a level has two
runs they are merged, bucket by bucket, to one of the next level.

Documents come in batches from the largest ids down, so the first batch with a key holds
its last document, and what later batches add is the number of documents only. When all
batches are in, the runs tell which keys are in enough documents, and every document loses
the lines whose key a larger id holds.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, materialize, order_key, scratch, slices, small_batches, step_path, text_buffer, tidy

#: What is stripped at both ends of a line.
BLANK = b" \t\n\x0b\x0c\r"
#: Batches of documents.
BATCHES = 6


def key_of(line: bytes) -> bytes:
    """The key of a line in UTF-8 (``bytes.lower`` changes A-Z only)."""
    return line.strip(BLANK).lower()


def _long(key: bytes, chars: int) -> bool:
    """Whether a key has so many code points."""
    n = len(key)
    return n >= chars and (n >= 4 * chars or n - sum(b & 0xC0 == 0x80 for b in key) >= chars)


def _keys(chars: int):
    """A row (h1, h2, ord, th) for each different key of a document that is long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, start, size = text_buffer(batch.column("text"))
            data, found, count = memoryview(raw), [], []
            for a, n in zip(start.tolist(), size.tolist(), strict=True):
                own = {xxhash.xxh3_128_digest(k) for k in map(key_of, bytes(data[a : a + n]).split(b"\n")) if _long(k, chars)}
                found.extend(own)
                count.append(len(own))
            h = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
            row = np.repeat(np.arange(batch.num_rows), count)
            cols = [pa.array(h[:, 0]), pa.array(h[:, 1]), *(batch.column(c).take(pa.array(row)) for c in ("ord", "th", "batch"))]
            yield pa.RecordBatch.from_arrays(cols, names=["h1", "h2", "ord", "th", "batch"])

    return run


def _cut(keep_text: bool):
    """Documents without the lines whose keys are in (d1, d2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, start, size = text_buffer(batch.column("text"))
            data, kept, lines, dropped = memoryview(raw), [], [], []
            d1, d2 = (batch.column(c).to_pylist() for c in ("d1", "d2"))
            for i, (a, n) in enumerate(zip(start.tolist(), size.tolist(), strict=True)):
                text = bytes(data[a : a + n])
                own, left = text.count(b"\n") + 1, None
                if d1[i]:
                    gone = set(np.array([d1[i], d2[i]], dtype="<i8").T.tobytes()[k : k + 16] for k in range(0, 16 * len(d1[i]), 16))
                    left = [x for x in text.split(b"\n") if xxhash.xxh3_128_digest(key_of(x)) not in gone]
                    text = b"\n".join(left)
                lines.append(own)
                dropped.append(0 if left is None else own - len(left))
                kept.append(text)
            cols = [batch.column("id"), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string())]
            names = ["id", "n_lines", "n_dropped", "kept_sha256"]
            if keep_text:
                cols.append(pa.array(kept, pa.binary()).cast(pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


class Runs:
    """Levelled sorted runs of rows (h1, h2, n, last): documents that hold a key, and the largest id of these.

    A key may have a row in several runs; ``n`` adds up over them and the largest ``last``
    counts. A level has one run at most between batches, of about 2 ** level batches, so a batch
    meets a number of runs that grows with the logarithm of the batches. Runs live in the shared
    folder; the catalog knows them until ``close``.
    """

    def __init__(self, spark: SparkSession, enough: int):
        self.spark, self.enough = spark, enough
        self.buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.levels: list[tuple[str, str] | None] = []

    def _store(self, rows: DataFrame) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex}", step_path(self.spark, "run")
        rows.select("h1", "h2", "n", "last").write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", path).saveAsTable(name)
        return name, path

    def _merge(self, one: tuple[str, str], two: tuple[str, str]) -> tuple[str, str]:
        """Both runs as one: a join of bucketed tables, so nothing is shuffled."""
        a, b = (self.spark.table(name) for name, _ in (one, two))
        both = a.join(b.select("h1", "h2", F.col("n").alias("m"), F.col("last").alias("then")), ["h1", "h2"], "full")
        n = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
        run = self._store(both.select("h1", "h2", n.alias("n"), F.greatest("last", "then").alias("last")))
        self._drop(one)
        self._drop(two)
        return run

    def _drop(self, run: tuple[str, str]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run[0]}")
        delete(self.spark, run[1])

    def _push(self, run: tuple[str, str]) -> None:
        level = 0
        while level < len(self.levels) and self.levels[level] is not None:
            run, self.levels[level] = self._merge(self.levels[level], run), None
            level += 1
        self.levels[level : level + 1] = [run]

    def add(self, keys: DataFrame) -> None:
        """A batch's keys (h1, h2, n, last), each once.

        Only those are added of which the runs know too few documents yet, or a smaller last one.
        """
        seen, last, rows = F.lit(0), F.lit(None).cast("long"), keys
        for k, run in enumerate(filter(None, self.levels)):
            rows = rows.join(self.spark.table(run[0]).select("h1", "h2", F.col("n").alias(f"n{k}"), F.col("last").alias(f"last{k}")), ["h1", "h2"], "left")
            seen, last = seen + F.coalesce(F.col(f"n{k}"), F.lit(0)), F.greatest(last, F.lit(None).cast("long"), F.col(f"last{k}"))
        self._push(self._store(rows.where((seen < self.enough) | last.isNull() | (F.col("last") > last))))

    def frequent(self) -> DataFrame:
        """(h1, h2, last) of the keys that enough documents hold; all runs become one."""
        runs = list(filter(None, self.levels))
        while len(runs) > 1:
            runs[:2] = [self._merge(runs[0], runs[1])]  # the smallest first
        self.levels = runs
        return self.spark.table(runs[0][0]).where(F.col("n") >= self.enough).select("h1", "h2", "last")

    def close(self) -> None:
        for run in filter(None, self.levels):
            self._drop(run)
        self.levels = []


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = BATCHES, keep_text: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without lines that a document of a larger id holds, too, if enough documents do.

    Keys of at least ``min_chars`` code points in at least ``min_docs`` documents lose all their
    lines but those of the largest id. Every row is a document: rows that share an id count
    each, and rows with a key's largest id all keep it. Null is smaller than all other ids; a
    null or empty text is one empty line; an empty table gives no row. Returns id, ``n_lines``
    (before), ``n_dropped``, ``kept_sha256`` and, with ``keep_text``, ``kept``; other columns of
    ``docs`` don't matter and aren't returned.

    Exact up to 128-bit hashes. Keys are shuffled once as hashes and once more to find those
    to drop; texts are shuffled once, to meet what they lose. Keys of a document are at most
    its lines; a key that any number of documents share is one row of each task before it moves.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].alias("id"), order_key(docs[id_col]).alias("ord"), F.xxhash64(text).alias("th"), text.alias("text"))
    with scratch(spark):
        cuts = rows.stat.approxQuantile("ord", [k / batches for k in range(1, batches)], 0.01) if batches > 1 else []
        cuts = [int(c) for c in cuts]  # as many as batches, whatever the number of rows
        batch = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col("ord"))) if cuts else F.lit(0)
        found = rows.withColumn("batch", batch).select("ord", "th", "batch", "text").mapInArrow(tidy(_keys(min_chars)), "h1 long, h2 long, ord long, th long, batch int")
        path = step_path(spark, "keys")
        found.write.partitionBy("batch").parquet(path)
        keys = spark.read.schema("h1 long, h2 long, ord long, th long, batch int").parquet(path)
        runs = Runs(spark, min_docs)
        try:
            for k in range(batches):
                own = keys.where(F.col("batch") == k)
                runs.add(own.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("ord").alias("last")))
            frequent = materialize(runs.frequent(), "frequent")
        finally:
            runs.close()
        pairs = keys.join(frequent, ["h1", "h2"]).where(F.col("ord") < F.col("last"))
        gone = pairs.groupBy("ord", "th").agg(F.collect_set(F.struct("h1", "h2")).alias("d"))
        gone = materialize(gone.select("ord", "th", F.transform("d", lambda x: x["h1"]).alias("d1"), F.transform("d", lambda x: x["h2"]).alias("d2")), "gone", lasting=True)
    whole = rows.withColumn("th", F.coalesce("th", F.lit(0))).join(gone, ["ord", "th"], "left").select("id", "text", "d1", "d2")
    kind = docs.schema[id_col].dataType.simpleString()
    return whole.mapInArrow(tidy(_cut(keep_text)), f"id {kind}, n_lines long, n_dropped long, kept_sha256 string" + (", kept string" if keep_text else "")).withColumnRenamed("id", id_col)


def oracle(min_chars: int = 20, min_docs: int = 3) -> str:
    """The query's rows as DuckDB SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, k, lines[k] AS line, translate(trim(lines[k], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{upper}', '{lower}') AS key FROM s, LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS k)),
f AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= {min_chars} GROUP BY key HAVING count(DISTINCT doc_id) >= {min_docs}),
g AS (SELECT doc_id, count(*) AS n_lines, count(f.key) FILTER (WHERE doc_id <> last) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE f.key IS NULL OR doc_id = last), '') AS kept FROM l LEFT JOIN f USING (key) GROUP BY doc_id)
SELECT doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM g"""
