"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Vectors are scaled to length one, where a cosine is a Euclidean distance. A table's key is
``k`` quantised random projections floor((a.x + b) / r); vectors that share a key in some of
the ``tables`` tables are compared exactly, in double precision. ``k`` follows from the
number of vectors (so that unrelated ones rarely share a key) and ``tables`` from the wanted
recall of pairs that are just similar enough.

Equal vectors are one row with a weight. A crowded key's vectors are cut into blocks and
each pair of blocks is a task's unit of work; what comes out of a unit is the number of
links of each vector and a spanning forest of the links, never the links themselves. A pair
that shares several keys counts in the first such table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forest, materialize, order_key, text_buffer

#: Width of a quantisation step; about the best for cosines near 0.95.
STEP = 2.0
#: Unrelated vectors that may share a vector's key in a table, on average.
STRANGERS = 16
#: Rows of a block.
BLOCK = 1024
#: Wanted share of the pairs exactly at the threshold that share a key.
RECALL = 0.998


def _normal(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def collision(distance: float, step: float = STEP) -> float:
    """Probability that one projection quantises points at this distance alike."""
    t = step / distance
    return 1 - 2 * _normal(-t) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(rows: int, threshold: float) -> tuple[int, int]:
    """(projections in a key, tables) for so many vectors and this cosine."""
    near, far = collision(math.sqrt(max(2 - 2 * threshold, 1e-4))), collision(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(rows, 2) / STRANGERS) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - near**k)))


class Tables:
    """The hash tables' projections for vectors of one dimension."""

    def __init__(self, dim: int, k: int, tables: int, seed: int):
        rng = np.random.default_rng([seed, dim])
        self.shape = (tables, k)
        self.along = rng.standard_normal((dim, k * tables))
        self.offset = rng.uniform(0, STEP, k * tables)
        self.mix = rng.integers(1, 2**62, (tables, k), dtype=np.int64) | 1
        self.salt = np.arange(tables) * np.int64(0x51D7348D2F9B6C15) + dim

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """A row of keys, one for each table, for each unit vector."""
        cell = np.floor((unit @ self.along + self.offset) / STEP).astype(np.int64).reshape(len(unit), *self.shape)
        keys = (cell * self.mix[None]).sum(axis=2) + self.salt[None]
        keys ^= keys >> 29
        return keys * np.int64(0x2545F4914F6CDD1D)


class Hasher:
    """Unit vectors and keys of packed vectors of any dimensions."""

    def __init__(self, k: int, tables: int, seed: int, kind: str):
        self.plan, self.kind, self.ready = (k, tables, seed), np.dtype(kind), {}

    def units(self, raw: np.ndarray, dim: int) -> np.ndarray:
        x = raw.view(self.kind).astype(np.float64).reshape(-1, dim)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.sqrt((x * x).sum(axis=1))[:, None]

    def keys(self, unit: np.ndarray) -> np.ndarray:
        dim = unit.shape[1]
        if dim not in self.ready:
            self.ready[dim] = Tables(dim, *self.plan)
        return self.ready[dim].keys(unit)


def _packed(kind: str):
    """Vectors as bytes; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            at = np.asarray(column.offsets)
            flat = column.values.to_numpy(zero_copy_only=False).astype(kind)
            ok = np.asarray(column.is_valid())
            raw = [flat[at[i] : at[i + 1]].tobytes() if ok[i] else None for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column("ord"), pa.array(raw, pa.binary())], names=["ord", "raw"])

    return run


def _hash(hasher: Hasher):
    """A row (key, table, node) for each vector and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column("node").to_numpy(zero_copy_only=False)
            raw, start, size = text_buffer(batch.column("raw"))
            for length in np.unique(size).tolist():
                own = np.flatnonzero(size == length)
                data = np.concatenate([raw[a : a + length] for a in start[own].tolist()])
                keys = hasher.keys(hasher.units(data, length // hasher.kind.itemsize))
                tab = np.tile(np.arange(keys.shape[1], dtype=np.int32), len(own))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(tab), pa.array(np.repeat(node[own], keys.shape[1]))], names=["key", "tab", "node"])

    return run


def _compare(threshold: float, hasher: Hasher):
    """Units of work: links of each vector (weighted) as kind 0, forest edges as kind 1."""

    def links(x, y, kx, ky, t):
        cos = x @ y.T
        hit = cos >= threshold
        near = np.abs(cos - threshold) < 1e-12  # BLAS may round either way: decide in a fixed order
        if near.any():
            i, j = np.nonzero(near)
            hit[i, j] = [math.fsum(p) >= threshold for p in (x[i] * y[j]).tolist()]
        i, j = np.nonzero(hit)
        if t:
            fresh = ~(kx[i, :t] == ky[j, :t]).any(axis=1) if len(i) < 200_000 else np.concatenate([~(kx[i[s : s + 200_000], :t] == ky[j[s : s + 200_000], :t]).any(axis=1) for s in range(0, len(i), 200_000)])
            i, j = i[fresh], j[fresh]
        return i, j

    def work(t, side, node, weight, x, keys):
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # 2: a block with itself
        i, j = links(x[left], x[right], keys[left], keys[right], t)
        i, j = left[i], right[j]
        if len(left) and side[left[0]] == 2:
            i, j = i[i < j], j[i < j]
        if not len(i):
            return None
        count = np.bincount(i, weights=weight[j], minlength=len(node)) + np.bincount(j, weights=weight[i], minlength=len(node))
        hit = np.flatnonzero(count)
        tree = forest(pd.DataFrame({"a": node[i], "b": node[j]})) if len(i) > 1 else pd.DataFrame({"a": node[i], "b": node[j]})
        return np.append(np.zeros(len(hit)), np.ones(len(tree))), np.append(node[hit], tree["a"]), np.append(count[hit].astype(np.int64), tree["b"])

    def units(batch: pa.Table, last: bool):
        # (what the whole units give, the rows of the last one if it may go on)
        batch = batch.combine_chunks()
        k = [batch.column(c).to_numpy() for c in ("key", "p", "q")]
        new = np.ones(batch.num_rows, dtype=bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in k])
        start = np.flatnonzero(new)
        end = np.append(start[1:], batch.num_rows)
        rest = None
        if not last:
            rest = batch.slice(int(start[-1]))
            start, end = start[:-1], end[:-1]
        t, side, node, weight = (batch.column(c).to_numpy() for c in ("tab", "side", "node", "weight"))
        raw, at, size = text_buffer(batch.column("raw").chunk(0))
        out = []
        for length in np.unique(size).tolist():  # a unit's vectors have one dimension; else its key came about by chance
            rows = np.flatnonzero(size == length)
            data = np.concatenate([raw[a : a + length] for a in at[rows].tolist()])
            x = hasher.units(data, length // hasher.kind.itemsize)
            keys = hasher.keys(x)
            for s, e in zip(np.searchsorted(rows, start).tolist(), np.searchsorted(rows, end).tolist(), strict=True):
                if e - s > 1:
                    own = rows[s:e]
                    done = work(int(t[own[0]]), side[own], node[own], weight[own], x[s:e], keys[s:e])
                    if done is not None:
                        out.append(done)
        if not out:
            return None, rest
        kind, a, b = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(kind.astype(np.int32)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], names=["kind", "a", "b"]), rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if batch.num_rows:
                new = pa.Table.from_batches([batch])
                done, held = units(new if held is None else pa.concat_tables([held, new]), False)
                if done is not None:
                    yield done
        if held is not None and held.num_rows:
            done, _ = units(held, True)
            if done is not None:
                yield done

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 17) -> DataFrame:
    """Groups of vectors linked by cosines of at least ``threshold``.

    Returns a row for each input row: id, ``n_links`` (other rows linked directly, repeated
    vectors included), ``component_id`` (smallest id reachable by links, itself included) and
    ``kept`` (id = component_id; the first of a group). Null, empty and zero vectors and those
    with null or non-finite components link with nothing; vectors of different dimensions
    don't link. A null id is smaller than all others; its group's ``component_id`` is null
    and ``kept`` is true for the null row only.
    """
    spark = vectors.sparkSession
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    array = vectors[vector_col] if single else vectors[vector_col].cast("array<double>")
    fine = (F.size(array) > 0) & F.forall(array, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists(array, lambda v: v != 0)
    kind = "<f4" if single else "<f8"
    rows = vectors.select(order_key(vectors[id_col]).alias("ord"), F.when(F.coalesce(fine, F.lit(False)), array).alias("embedding"))
    members = materialize(rows.mapInArrow(_packed(kind), "ord long, raw binary").withColumn("node", F.when(F.col("raw").isNotNull(), F.xxhash64("raw"))), "members")
    distinct = materialize(members.where("node is not null").groupBy("node").agg(F.first("raw").alias("raw"), F.count("*").alias("weight")), "vectors")
    k, tables = plan(distinct.count(), threshold)
    hasher = Hasher(k, tables, seed, kind)

    hashed = materialize(distinct.select("node", "raw").mapInArrow(_hash(hasher), "key long, tab int, node long"), "hashed")
    crowd = hashed.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    placed = hashed.join(crowd, "key").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # the units (p, q) with p <= q of a key; a row of block x takes part in all with p = x or q = x
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    unit = placed.select("key", "tab", "node", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), side.alias("side"))
    dealt = unit.join(distinct, "node").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "node")
    found = materialize(dealt.select("key", "p", "q", "tab", "side", "node", "weight", "raw").mapInArrow(_compare(threshold, hasher), "kind int, a long, b long"), "links")
    members = members.select("ord", "node")

    count = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("linked"))
    label = components(found.where("kind = 1").select("a", "b"))
    twins = distinct.select("node", (F.col("weight") - 1).alias("twins"))
    known = twins.join(count, "node", "left").join(label, "node", "left").select("node", (F.col("twins") + F.coalesce("linked", F.lit(0))).alias("n"), F.coalesce("component", "node").alias("comp"))
    named = materialize(members.join(known, "node", "left"), "named")
    least = named.where("comp is not null").groupBy("comp").agg(F.min("ord").alias("least"))
    out = named.join(least, "comp", "left").select("ord", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "ord").alias("least"))
    null = F.lit(-(2**63))
    return out.select(F.when(F.col("ord") != null, F.col("ord")).alias(id_col), "n_links", F.when(F.col("least") != null, F.col("least")).alias("component_id"), (F.col("ord") == F.col("least")).alias("kept"))
