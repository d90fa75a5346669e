"""Helpers that several operators of this subpackage share.

* ``materialize`` cuts lineage through a Parquet table in the cluster's shared
  checkpoint folder, so that a lost executor costs a re-read and not a re-run.
* ``components`` finds connected components by rounds of contraction; links and labels
  stay in distributed tables all the time.
* ``text_buffer`` exposes an Arrow string column as one NumPy byte buffer.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Edges of a graph that one task may hold (16 bytes each).
FEW = 100_000
#: Stands for a null id wherever ids are ordered: nulls come first and equal each other.
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        named = "file://" + tempfile.mkdtemp(prefix="curastra-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Folder of the steps of the operator at work, if that deletes them in the end.
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized in here go when it ends, but for those with ``lasting``."""
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    token = _SCRATCH.set(path)
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system Spark writes to."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def step_path(spark: SparkSession, tag: str, lasting: bool = False) -> str:
    """A new name in the shared folder, among the steps that ``scratch`` deletes unless it is ``lasting``."""
    root = None if lasting else _SCRATCH.get()
    return f"{root or shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it back."""
    spark = df.sparkSession
    path = step_path(spark, tag, lasting)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of finished steps now, not at the driver's next collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: What this worker remembers between tasks, by operator: a function that forgets it.
MEMOS: dict[str, Callable[[], None]] = {}


def tidy(run: Callable, memo: str | None = None) -> Callable:
    """A function for ``mapInArrow`` that gives freed memory back to the system after its task.

    Workers serve many tasks of all kinds; what the allocators keep from one would add up.
    A worker that turns to another operator forgets what it remembers for the last one.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, forget in MEMOS.items():
            if name != memo:
                forget()
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return wrapped


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2_500, size: int = 8_000_000, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows and ``size`` bytes of ``column`` (or one row).

    For work whose arrays are many times its input; nothing is copied.
    """
    for batch in batches:
        n = batch.num_rows
        if column not in batch.schema.names:
            bounds = [*range(0, n, rows), n]
        else:
            total = np.append(0, np.cumsum(text_buffer(batch.column(column))[2]))
            bounds = [0]
            while bounds[-1] < n:
                a = bounds[-1]
                bounds.append(min(a + rows, n, max(a + 1, int(np.searchsorted(total, total[a] + size, side="right")) - 1)))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def small_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Let Arrow batches of this session have at most so many rows.

    Whole texts travel in them, and both sides of a Python worker hold some at a time; Spark's
    10,000 rows can be hundreds of MB. It changes memory, not results.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def order_key(col) -> F.Column:
    """Ids as longs in which null is the smallest."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(NULL_ID)).cast("long")


def id_of(ord_col: str) -> F.Column:
    """Undo ``order_key``."""
    return F.when(F.col(ord_col) != F.lit(NULL_ID), F.col(ord_col))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, lengths) of an Arrow string or binary column; null counts as empty."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        empty = np.zeros(0, dtype=np.int64)
        return np.zeros(0, dtype=np.uint8), empty, empty
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    bounds = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    length = bounds[1:] - bounds[:-1]
    if column.null_count:
        length = np.where(np.asarray(column.is_valid()), length, 0)
    return raw, bounds[:-1], length


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    k = 1
    while 2 * k <= width:
        a = np.minimum(a[:-k], a[k:])
        k *= 2
    return np.minimum(a[: len(a) - (width - k)], a[width - k :]) if k < width else a


def forest(pairs: pd.DataFrame) -> pd.DataFrame:
    """Edges (a, b) reduced to one edge from each node to its root among these edges."""
    nodes, flat = np.unique(np.concatenate([pairs["a"].to_numpy(), pairs["b"].to_numpy()]), return_inverse=True)
    n = len(pairs)
    parent = list(range(len(nodes)))
    for x, y in zip(flat[:n].tolist(), flat[n:].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    for i in range(len(parent)):  # a parent is smaller than its child, so it is final already
        parent[i] = parent[parent[i]]
    root = np.array(parent, dtype=np.int64)
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return pd.DataFrame({"a": nodes[moved], "b": nodes[root[moved]]})


def _forests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    kept, rows = [], 0
    for frame in frames:
        kept.append(frame)
        rows += len(frame)
        if rows >= 1_000_000:
            kept = [forest(pd.concat(kept))]
            yield kept[0]
            kept, rows = [], 0
    if rows:
        yield forest(pd.concat(kept))


def _solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """All edges of a small graph: the component of each node."""
    kept = list(frames)
    tree = forest(pd.concat(kept)) if sum(map(len, kept)) else pd.DataFrame({"a": [], "b": []}, dtype="int64")
    roots = np.unique(tree["b"].to_numpy())
    yield pd.DataFrame({"node": np.append(tree["a"], roots), "component": np.append(tree["b"], roots)})


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges (a, b) of longs: rows (node, component).

    Tasks reduce their edges to forests. While more than ``FEW`` edges are left, a round hooks
    every node to its smallest neighbour, renames the edges' ends and drops those that became
    loops. Minima have map-side partial aggregates, so a hub with a third of all edges doesn't
    meet in one task; edges shrink geometrically. The last ``FEW`` edges are one task's work.
    Empty edges give an empty result; repeated edges and loops change nothing.
    """
    pairs = edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    left = materialize(pairs.mapInPandas(_forests, "a long, b long"), "edges")
    label = None
    while left.count() > FEW:
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up")), "hooks")
        label = hook.select("node", F.col("up").alias("component")) if label is None else _renamed(label, hook.select("node", F.col("up").alias("to")))
        label = materialize(label, "labels")
        one = left.join(hook.select(F.col("node").alias("a"), F.col("up").alias("x")), "a")
        two = one.join(hook.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
        moved = two.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        left = materialize(moved.mapInPandas(_forests, "a long, b long"), "edges")
    last = materialize(left.coalesce(1).mapInPandas(_solve, "node long, component long"), "labels")
    return last if label is None else materialize(_renamed(label, last.withColumnRenamed("component", "to")), "labels")


def _renamed(label: DataFrame, to: DataFrame) -> DataFrame:
    """Components renamed by rows (node, to)."""
    return label.join(to.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
