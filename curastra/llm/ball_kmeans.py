"""k-means on integer vectors, with clusters as balls.

A cluster is a ball: its centroid and a radius that no member exceeds. Another centroid
matters to a cluster only if half the way to it is within the radius: it is a neighbour.
Neighbours, nearest first, cut the ball into a stable core and annuli: a member closer to its
centroid than half the way to the first neighbour stays without any comparison, and one
between half the ways to neighbours a and a + 1 is compared with the first a of them only.
All that is decided in exact integers, so the result is that of comparing every vector with
every centroid, ties included.

A round is one pass over the stored vectors with their clusters. Tasks add up, for each
cluster, the members' components, their number and the largest distance; sums meet by
component, and the driver gets ``k * dim`` numbers. Once centroids have moved, a radius is
at most the old one and the way its centroid went.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete, scratch, step_path, tidy

#: Integer components up to this size: distances and four times them fit 64 bits for 64 components.
LARGEST = 2**26


@dataclass
class Balls:
    """Centroids, and for each its neighbours and their squared distances, nearest first."""

    centre: np.ndarray
    near: list[np.ndarray]
    gap: list[np.ndarray]

    @classmethod
    def of(cls, centre: np.ndarray, radius: np.ndarray) -> Balls:
        """``radius``: an upper bound for each ball, negative for one without members."""
        near, gap = [], []
        for i, c in enumerate(centre):
            between = squared(centre, c)
            order = np.lexsort((np.arange(len(centre)), between))
            order = order[(order != i) & (between[order] <= 4 * (radius[i] * (1 + 1e-9)) ** 2)]
            near.append(order)
            gap.append(between[order])
        return cls(centre, near, gap)


def squared(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    apart = x - centre
    return np.einsum("ij,ij->i", apart, apart)


def assign(x: np.ndarray, own: np.ndarray, balls: Balls) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of vectors whose last centroids were ``own`` (-1: none yet)."""
    best, far = np.array(own), np.zeros(len(x), dtype=np.int64)
    for i in np.unique(own).tolist():
        rows = np.flatnonzero(own == i)
        if i < 0:
            at, d, rivals = np.zeros(len(rows), dtype=np.int64), squared(x[rows], balls.centre[0]), range(1, len(balls.centre))
            ring = np.full(len(rows), len(balls.centre))
        else:
            at, d, rivals = np.full(len(rows), i), squared(x[rows], balls.centre[i]), balls.near[i].tolist()
            ring = np.searchsorted(balls.gap[i], 4 * d, side="right")  # 0: the stable core
        for a, j in enumerate(rivals):
            within = np.flatnonzero(ring > a)
            if not len(within):
                break
            other = squared(x[rows[within]], balls.centre[j])
            won = (other < d[within]) | ((other == d[within]) & (j < at[within]))
            at[within[won]], d[within[won]] = j, other[won]
        best[rows], far[rows] = at, d
    return best, far


def _pack(dim: int, scale: int):
    """Vectors as packed integers, in no cluster yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            raw = np.floor(flat * scale).astype("<i4")
            none = pa.array(np.full(batch.num_rows, -1, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([r.tobytes() for r in raw], pa.binary()), none], names=["id", "raw", "own"])

    return run


def _round(balls: Balls, last: bool):
    """Rows (kind 0) with their new clusters; and, once a task, what its clusters add up to (kind 1)."""
    k, dim = balls.centre.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, most, total, sums = np.zeros(k, dtype=np.int64), np.full(k, -1, dtype=np.int64), [0] * k, np.zeros((k, dim), dtype=np.int64)
        kind = None
        for batch in batches:
            kind = batch.schema.field("id").type
            x = np.frombuffer(b"".join(batch.column("raw").to_pylist()), dtype="<i4").reshape(-1, dim).astype(np.int64)
            own, d = assign(x, batch.column("own").to_numpy().astype(np.int64), balls)
            for c in np.unique(own).tolist():
                rows = np.flatnonzero(own == c)
                count[c] += len(rows)
                most[c] = max(most[c], d[rows].max())
                total[c] += sum(d[rows].tolist())
                sums[c] += x[rows].sum(axis=0)
            n = batch.num_rows
            raw = pa.nulls(n, pa.binary()) if last else batch.column("raw")
            rest = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.decimal128(38, 0)), pa.nulls(n, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, dtype=np.int32)), batch.column("id"), raw, pa.array(own.astype(np.int32)), pa.array(d), *rest], names=_NAMES)
        if kind is not None:
            c = np.flatnonzero(count)
            n = len(c)
            cols = [pa.array(np.ones(n, dtype=np.int32)), pa.nulls(n, kind), pa.nulls(n, pa.binary()), pa.array(c.astype(np.int32)), pa.array(most[c]), pa.array(count[c])]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([total[i] for i in c], pa.decimal128(38, 0)), pa.array(sums[c].tolist(), pa.list_(pa.int64()))], names=_NAMES)

    return run


_NAMES = ["kind", "id", "raw", "own", "d", "n", "inertia", "sums"]


def _passed(spark: SparkSession, rows: DataFrame, balls: Balls, id_type: str, last: bool = False) -> tuple[str, DataFrame, DataFrame]:
    """A round: (where its rows are, the rows, what clusters add up to)."""
    schema = f"kind int, id {id_type}, raw binary, own int, d long, n long, inertia decimal(38,0), sums array<long>"
    path = step_path(spark, "round", lasting=last)
    rows.select("id", "raw", "own").mapInArrow(tidy(_round(balls, last)), schema).write.partitionBy("kind").parquet(path)
    found = spark.read.schema(schema).parquet(path)
    return path, found.where("kind = 0"), found.where("kind = 1")


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """k-means over the vectors of ``dim`` components, each floor(scale * component).

    The first centroids are the ``k`` vectors (fewer, if there are not so many) with the
    smallest sha256 of ``<seed>:<id>``; rows with one id are told apart by their vectors, a null
    id is the word null. Each of ``rounds`` rounds gives every vector to the nearest centroid
    (the smaller number, if equal) and moves centroids to their members' componentwise floor of
    the mean; one without members stays. A last pass gives vectors to the final centroids.

    Returns id, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia`` (sums of
    distances) and ``centroid_sha256``. Vectors that are null, of another length or with null or
    non-finite components have no row, nor those with an integer component over ``LARGEST``,
    whose squared distances 64 bits don't hold. Repeated rows count each; an empty table gives
    no row; other columns don't matter. The driver holds the centroids only.
    """
    spark = vectors.sparkSession
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    v = vectors[vector_col] if single else vectors[vector_col].cast("array<double>")
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < LARGEST)
    kept = vectors.where((F.size(v) == dim) & F.forall(v, fits)).select(vectors[id_col].alias("id"), v.alias("v"))
    id_type = vectors.schema[id_col].dataType.simpleString()
    out_schema = f"{id_col} {id_type}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    with scratch(spark):
        path = step_path(spark, "vectors")
        kept.mapInArrow(tidy(_pack(dim, scale)), f"id {id_type}, raw binary, own int").write.parquet(path)
        rows = spark.read.schema(f"id {id_type}, raw binary, own int").parquet(path)
        order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))), 256)
        first = rows.orderBy(order, "raw").limit(k).select("raw").collect()
        if not first:
            return spark.createDataFrame([], out_schema)
        centre = np.stack([np.frombuffer(bytes(r.raw), dtype="<i4") for r in first]).astype(np.int64)
        radius = np.full(len(centre), -1.0)
        for _ in range(rounds):
            then, (path, rows, sums) = path, _passed(spark, rows, Balls.of(centre, radius), id_type)
            delete(spark, then)
            each = sums.groupBy("own").agg(F.sum("n").alias("n"), F.max("d").alias("d"))
            parts = sums.select("own", F.posexplode("sums").alias("j", "s")).groupBy("own", "j").agg(F.sum("s").alias("s"))
            moved, reach = np.array(centre), np.full(len(centre), -1.0)
            for r in parts.join(each, "own").collect():  # k * dim rows
                moved[r.own, r.j] = r.s // r.n
                reach[r.own] = math.sqrt(r.d)
            way = np.sqrt(np.array([squared(a[None], b)[0] for a, b in zip(moved, centre, strict=True)], dtype=np.float64))
            radius, centre = np.where(reach < 0, -1.0, reach + way), moved
        _, rows, sums = _passed(spark, rows, Balls.of(centre, radius), id_type, last=True)
    inertia = {r.own: int(r.i) for r in sums.groupBy("own").agg(F.sum("inertia").alias("i")).collect()}  # k rows
    whole = sum(inertia.values())
    told = [(c, i, whole, hashlib.sha256(",".join(map(str, centre[c].tolist())).encode()).hexdigest()) for c, i in inertia.items()]
    known = spark.createDataFrame(told, "own int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = rows.select("id", "own", "d").join(F.broadcast(known), "own")  # k rows
    return out.select(F.col("id").alias(id_col), F.col("own").alias("cluster"), F.col("d").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3) -> str:
    """The query's rows as DuckDB SQL: every vector against every centroid in each round."""
    apart = f"CAST(list_sum(list_transform(range(1, {dim + 1}), lambda j: (v.e[j] - s.c[j]) * (v.e[j] - s.c[j]))) AS BIGINT)"
    return f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
first AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS own, e AS c FROM v ORDER BY own LIMIT {k}),
step AS (SELECT 0 AS round, own, c FROM first
UNION ALL
SELECT round, own, coalesce(moved, c) FROM (
 WITH a AS (SELECT v.vec_id, any_value(v.e) AS e, arg_min(s.own, {apart} * {k} + s.own) AS own FROM v, step s GROUP BY v.vec_id),
 p AS (SELECT own, j, CAST(floor(sum(e[j]) / count(*)) AS BIGINT) AS x FROM a, range(1, {dim + 1}) t(j) GROUP BY own, j),
 m AS (SELECT own, list(x ORDER BY j) AS moved FROM p GROUP BY own)
 SELECT s.round + 1 AS round, s.own, s.c, m.moved FROM step s LEFT JOIN m USING (own) WHERE s.round < {rounds})),
b AS (SELECT v.vec_id, arg_min(s.own, {apart} * {k} + s.own) AS own, min({apart}) AS d, FROM v, step s WHERE s.round = {rounds} GROUP BY v.vec_id)
SELECT vec_id, CAST(b.own AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY b.own) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM b JOIN step s ON s.own = b.own AND s.round = {rounds}"""
