"""Ranked lexical search over a clustered index of reordered documents, exact.

*Order.* Recursive graph bisection puts documents with the same terms side by side: a set of
documents is halved, and pairs of documents change halves as long as that shortens the gaps
in the posting lists. The top levels are fitted on a bounded sample of documents with hashed
terms; what comes out for each node is a weight for each term, by which every document is
routed to a leaf. A leaf is a shard, or several if it is crowded, and within a shard
documents are bisected by their own terms down to clusters of ``CLUSTER`` neighbours.

*Index.* A shard has a row for each of its terms: places, impacts (the part of the score that
doesn't depend on the query), and the largest impact in each cluster.

*Search.* The largest impacts give an upper bound of a query's score in each cluster. A query
visits the shards with the largest bounds first, and in a shard the clusters in order of
bound, until the next bound is below the score of its last result so far; a bound that is
equal still counts, as an earlier doc_id wins a tie. Then shards whose bound reaches the last
score known by then are visited, and so on; so nothing that could rank is left out.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_of, materialize, order_key, scratch, slices, small_batches, text_buffer, tidy

#: Bytes that no term has; a term keeps everything else, A-Z as a-z.
APART = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_TABLE = bytes(0x20 if b in APART else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
#: Bytes of text split at a time.
BLOCK = 4_000_000
#: Documents that the top of the bisection is fitted on, hashed terms there, levels at most.
SAMPLE, HASHED, LEVELS = 8_192, 2**14, 6
#: Documents and bytes of terms of a shard (about), documents of a cluster, passes over a level.
SHARD, SHARD_BYTES, CLUSTER, PASSES = 4_096, 16_000_000, 128, 3
#: Queries' terms that are looked up together; shards that a query visits at first, and next.
TOGETHER, VISITS = 100_000, (16, 256, None)

_ROWS = "shard int, term binary, df long, pos binary, q binary, cl binary, mx binary"


def counted(text: bytes) -> Counter:
    """How often each term occurs in a text in UTF-8."""
    flat = text.translate(_TABLE)
    if len(flat) <= BLOCK:
        return Counter(flat.split())
    out, a = Counter(), 0
    while a < len(flat):
        b = flat.find(b" ", a + BLOCK)
        b = len(flat) if b < 0 else b
        out.update(flat[a:b].split())
        a = b
    return out


def bisected(doc: np.ndarray, term: np.ndarray, n: int, terms: int, levels: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Halve documents level by level; postings are pairs (doc, term), sorted by doc.

    Yields (node of each document, weights, biases) after each level: nodes of a level are
    numbered from left to right, and a document goes right of a node of the level above if the
    weights of its terms add up to more than the bias.
    """
    node = np.zeros(n, dtype=np.int64)
    for level in range(levels):
        nodes = 1 << level
        place = np.argsort(node, kind="stable")
        size = np.bincount(node, minlength=nodes)
        rank = np.empty(n, dtype=np.int64)
        rank[place] = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
        side = (rank >= (size[node] + 1) // 2).astype(np.int64)
        right = np.bincount(node, weights=side, minlength=nodes)
        n0, n1 = (np.maximum(x, 1)[:, None] for x in (size - right, right))
        cell = node[doc] * terms + term
        whole = np.bincount(cell, minlength=nodes * terms).reshape(nodes, terms).astype(np.float32)
        for last in [False] * PASSES + [True]:
            d1 = np.bincount(cell, weights=side[doc], minlength=nodes * terms).reshape(nodes, terms).astype(np.float32)
            d0 = whole - d1
            if last:
                break
            now = d0 * np.log2(n0 / (d0 + 1)) + d1 * np.log2(n1 / (d1 + 1))
            to1 = now - (d0 - 1) * np.log2(n0 / np.maximum(d0, 1)) - (d1 + 1) * np.log2(n1 / (d1 + 2))
            to0 = now - (d1 - 1) * np.log2(n1 / np.maximum(d1, 1)) - (d0 + 1) * np.log2(n0 / (d0 + 2))
            gain = np.bincount(doc, weights=np.where(side[doc] == 0, to1.ravel()[cell], to0.ravel()[cell]), minlength=n)
            order = np.lexsort((-gain, side, node))
            first = np.searchsorted(node[order] * 2 + side[order], np.arange(2 * nodes))
            place = np.arange(n) - first[node[order] * 2 + side[order]]
            left, rite = order[side[order] == 0], order[side[order] == 1]
            key = node[order] * n + place
            _, i, j = np.intersect1d(key[side[order] == 0], key[side[order] == 1], assume_unique=True, return_indices=True)
            swap = gain[left[i]] + gain[rite[j]] > 1e-6
            if not swap.any():
                continue
            side[left[i[swap]]], side[rite[j[swap]]] = 1, 0
        weight = np.log2(n0 / (d0 + 1)) - np.log2(n1 / (d1 + 1))
        score = np.bincount(doc, weights=weight.ravel()[cell], minlength=n)
        order = np.lexsort((score, node))
        first = np.cumsum(size) - size
        bias = np.where(size > 0, score[order[np.minimum(first + size // 2, n - 1)]], 0.0)
        node = node * 2 + side
        yield node, weight.astype(np.float32), bias


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        raw, start, size = text_buffer(batch.column("text"))
        data = memoryview(raw)
        ids = [np.unique(_hashed(counted(bytes(data[a : a + n])))).astype("<u2").tobytes() for a, n in zip(start.tolist(), size.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], names=["ids"])


def _hashed(terms) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, terms), dtype=np.int64, count=len(terms)) % HASHED


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sample's bisection: a row (level, weights, biases) for each level."""
    sets = [np.frombuffer(x, dtype="<u2").astype(np.int64) for batch in batches for x in batch.column("ids").to_pylist() if x]
    levels = min(LEVELS, max(0, int(np.log2(max(len(sets), 1) / 64))))
    if levels:
        doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        for k, (_, weight, bias) in enumerate(bisected(doc, np.concatenate(sets), len(sets), HASHED, levels)):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([weight.tobytes()], pa.binary()), pa.array([bias.astype("<f8").tobytes()], pa.binary())], names=["level", "weight", "bias"])


def _forward(model: list[tuple[np.ndarray, np.ndarray]]):
    """Documents with terms: a row (ord, n, terms, tf, leaf, salt) each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = 0
        for batch in slices(batches):
            raw, start, size = text_buffer(batch.column("text"))
            data, rows = memoryview(raw), []
            for i, (a, n) in enumerate(zip(start.tolist(), size.tolist(), strict=True)):
                found = counted(bytes(data[a : a + n]))
                if found:
                    tf = np.fromiter(found.values(), dtype="<u4", count=len(found))
                    rows.append((i, int(tf.sum(dtype=np.int64)), b" ".join(found), tf.tobytes(), _hashed(found) if model else ()))
            if not rows:
                continue
            at, n, terms, tf, ids = zip(*rows, strict=True)
            leaf = np.zeros(len(rows), dtype=np.int64)
            if model:
                doc, term = np.repeat(np.arange(len(rows)), [len(x) for x in ids]), np.concatenate(ids)
                for weight, bias in model:
                    score = np.bincount(doc, weights=weight.ravel()[leaf[doc] * HASHED + term], minlength=len(rows))
                    leaf = 2 * leaf + (score > bias[leaf])
            cols = [batch.column("ord").take(pa.array(at)), pa.array(n, pa.int64()), pa.array(terms, pa.binary()), pa.array(tf, pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(leaf.astype(np.int32)), pa.array(np.arange(salt, salt + len(rows)))], names=["ord", "n", "terms", "tf", "leaf", "salt"])
            salt += len(rows)

    return run


def _binary(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Arrays of ``data`` from bound to bound, as bytes."""
    offsets = (bounds * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _indexed(shard: int, rows: list[tuple], total: int, length: int) -> pa.RecordBatch:
    """A shard's rows of the index: its documents in their new order (no term), then its terms."""
    vocabulary: defaultdict[bytes, int] = defaultdict()
    vocabulary.default_factory = vocabulary.__len__
    ids = [np.array(list(map(vocabulary.__getitem__, r[2].split(b" "))), dtype=np.int64) for r in rows]
    n, tf = len(rows), np.concatenate([np.frombuffer(r[3], dtype="<u4") for r in rows]).astype(np.int64)
    doc, term = np.repeat(np.arange(n), [len(x) for x in ids]), np.concatenate(ids)
    place = np.arange(n)
    df = np.bincount(term, minlength=len(vocabulary))
    levels = max(0, int(np.ceil(np.log2(n / CLUSTER))))
    told = (df[term] > 1) & (df[term] <= n // 2)  # terms of one document or of most don't tell halves apart
    if levels and told.any():
        used, dense = np.unique(term[told], return_inverse=True)
        for node, *_ in bisected(doc[told], dense, n, len(used), levels):
            pass
        place[np.argsort(node, kind="stable")] = np.arange(n)
    m = np.array([50 + (50 * r[1] * total) // length for r in rows], dtype=np.int64)
    q = (1_000_000_000 * tf) // (1000 * tf + 20 * m[doc])
    order = np.lexsort((place[doc], term))
    term, pos, q = term[order], place[doc][order], q[order].astype("<i4")
    clusters = -(-n // CLUSTER)
    cell = term * clusters + pos // CLUSTER
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    mx, cl, owner = np.maximum.reduceat(q, first), (pos[first] // CLUSTER).astype("<u2"), term[first]
    bounds = np.searchsorted(term, np.arange(len(vocabulary) + 1))
    tops = np.searchsorted(owner, np.arange(len(vocabulary) + 1))
    ords = np.empty(n, dtype="<i8")
    ords[place] = [r[0] for r in rows]
    none = pa.array([b""], pa.binary())
    cols = [
        pa.array(np.full(len(vocabulary) + 1, shard, dtype=np.int32)),
        pa.array([None, *vocabulary], pa.binary()),
        pa.array(np.append(0, np.diff(bounds))),
        pa.concat_arrays([pa.array([ords.tobytes()], pa.binary()), _binary(pos.astype("<u2" if n <= 65_536 else "<u4"), bounds)]),
        *(pa.concat_arrays([none, x]) for x in (_binary(q, bounds), _binary(cl, tops), _binary(mx.astype("<i4"), tops))),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["shard", "term", "df", "pos", "q", "cl", "mx"])


def _index(total: int, length: int):
    """Rows in order of shard: the index of each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []
        for batch in batches:
            for s, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "ord", "n", "terms", "tf")), strict=True):
                if s != shard:
                    if rows:
                        yield _indexed(shard, rows, total, length)
                    shard, rows = s, []
                rows.append(row)
        if rows:
            yield _indexed(shard, rows, total, length)

    return run


@dataclass
class Index:
    """``rows`` (a row for each term of a shard), documents with terms, all their terms, shards."""

    rows: DataFrame
    documents: int
    length: int
    shards: int


def build(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all documents.

    Documents without terms (null, empty, nothing but blanks and ASCII signs) aren't in it. The
    fit of the bisection's top takes about ``SAMPLE`` rows at random as sets of hashed terms, one
    task's work; everything else covers all rows. A leaf with many documents or bytes is dealt
    out to several shards by row, so a group of copies of any size doesn't meet in one task.
    """
    spark = docs.sparkSession
    rows = docs.select(order_key(docs[id_col]).alias("ord"), docs[text_col].cast("string").alias("text"))
    some = rows.select("text").where(F.rand(11) < SAMPLE / max(rows.count(), 1))
    fitted = some.mapInArrow(tidy(_sketch), "ids binary").coalesce(1).mapInArrow(tidy(_fit), "level int, weight binary, bias binary")
    model = [(np.frombuffer(bytes(r.weight), dtype="<f4"), np.frombuffer(bytes(r.bias), dtype="<f8")) for r in sorted(fitted.collect(), key=lambda r: r.level)]
    forward = materialize(rows.mapInArrow(tidy(_forward(model)), "ord long, n long, terms binary, tf binary, leaf int, salt long"), "forward")
    size = F.sum(F.length("terms") + F.length("tf"))
    leaves = sorted((r.leaf, r.rows, r.length, r.size) for r in forward.groupBy("leaf").agg(F.count("*").alias("rows"), F.sum("n").alias("length"), size.alias("size")).collect())
    documents, length = sum(x[1] for x in leaves), sum(x[2] for x in leaves)
    parts = [0] * (1 << len(model))
    for leaf, n, _, size in leaves:
        parts[leaf] = max(-(-n // SHARD), -(-size // SHARD_BYTES))
    shards = max(1, sum(parts))
    own = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("leaf") + 1)  # noqa: E731  at most 2 ** LEVELS
    start = np.cumsum([0, *parts[:-1]]).tolist()
    shard = own(start) + F.pmod(F.xxhash64("salt", "ord"), own([max(1, p) for p in parts])).cast("int")
    dealt = forward.select(shard.cast("int").alias("shard"), "ord", "n", "terms", "tf").repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "ord", "n")
    return Index(materialize(dealt.mapInArrow(tidy(_index(documents, length)), _ROWS), "index"), documents, length, shards)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        raw, start, size = text_buffer(batch.column("text"))
        data = memoryview(raw)
        terms = [sorted(counted(bytes(data[a : a + n]))) for a, n in zip(start.tolist(), size.tolist(), strict=True)]
        at = pa.array(np.repeat(np.arange(batch.num_rows), [len(t) for t in terms]))
        yield pa.RecordBatch.from_arrays([batch.column("qid").take(at), pa.array([t for own in terms for t in own], pa.binary())], names=["qid", "term"])


class Shard:
    """A shard's rows for the terms of some queries."""

    def __init__(self, ords: bytes):
        self.ords = np.frombuffer(ords, dtype="<i8")
        self.clusters = -(-len(self.ords) // CLUSTER)
        self.terms: dict[int, tuple[bytes, ...]] = {}

    def bounds(self, plan: list[tuple[int, int]]) -> np.ndarray:
        """Upper bounds of a query's scores, by cluster."""
        out = np.zeros(self.clusters, dtype=np.int64)
        for t, w in plan:
            own = self.terms.get(t)
            if own is not None:
                out[np.frombuffer(own[2], dtype="<u2")] += w * np.frombuffer(own[3], dtype="<i4").astype(np.int64)
        return out

    def best(self, plan: list[tuple[int, int]], k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ords) of the ``k`` best documents with at least that score."""
        kind = "<u2" if len(self.ords) <= 65_536 else "<u4"
        held = [(w, self.terms[t]) for t, w in plan if t in self.terms]
        pos = np.concatenate([np.frombuffer(x[0], dtype=kind) for _, x in held]).astype(np.int64)
        part = np.concatenate([w * np.frombuffer(x[1], dtype="<i4").astype(np.int64) for w, x in held])
        bound = self.bounds(plan)
        order = np.argsort(-bound, kind="stable")
        scores, ords, a, step = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0, 1
        while a < len(order) and bound[order[a]] >= least:
            now = order[a : a + step]
            now = now[bound[now] >= least]
            wanted = np.zeros(self.clusters, dtype=bool)
            wanted[now] = True
            of = wanted[pos // CLUSTER]
            total = np.zeros(len(self.ords), dtype=np.int64)
            np.add.at(total, pos[of], part[of])
            hit = np.flatnonzero(total >= least)
            scores, ords = np.append(scores, total[hit]), np.append(ords, self.ords[hit])
            top = np.lexsort((ords, -scores))[:k]
            scores, ords = scores[top], ords[top]
            if len(scores) == k:
                least = max(least, int(scores[-1]))
            a, step = a + step, 2 * step
        return scores, ords


def _shards(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int, Shard, list[tuple]]]:
    """(number, shard, its rows without postings) from rows sorted by (shard, kind): documents, terms, others."""
    number, shard, rest = None, None, []
    for batch in batches:
        for s, kind, *row in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", *names)), strict=True):
            if s != number:
                if shard is not None:
                    yield number, shard, rest
                number, shard, rest = s, None, []
            if kind == 0:
                shard = Shard(row[1])
            elif kind == 1:
                shard.terms[row[0]] = tuple(row[1:5])
            else:
                rest.append(tuple(row))
    if shard is not None:
        yield number, shard, rest


def _bound(plans: dict[int, list[tuple[int, int]]]):
    """(qid, shard, best): the largest bound of a query in a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, shard, _ in _shards(batches, ["tno", "pos", "q", "cl", "mx"]):
            best = [(q, int(b.max())) for q, b in ((q, shard.bounds(plan)) for q, plan in plans.items()) if b.any()]
            qid, most = zip(*best, strict=True) if best else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(qid, pa.int64()), pa.array([number] * len(qid), pa.int32()), pa.array(most, pa.int64())], names=["qid", "shard", "best"])

    return run


def _visit(plans: dict[int, list[tuple[int, int]]], k: int):
    """(qid, score, ord) of the best documents of the shards that a query visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, shard, visits in _shards(batches, ["tno", "pos", "q", "cl", "mx", "qid", "least"]):
            found = [(q, *shard.best(plans[q], k, least)) for *_, q, least in visits]
            qid = np.repeat([q for q, *_ in found], [len(s) for _, s, _ in found]).astype(np.int64)
            scores, ords = (np.concatenate([f[i] for f in found] or [np.zeros(0, dtype=np.int64)]) for i in (1, 2))
            yield pa.RecordBatch.from_arrays([pa.array(qid), pa.array(scores), pa.array(ords)], names=["qid", "score", "ord"])

    return run


def search(index: Index, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The ``k`` best documents of each item: (id, ``rank`` from 1, doc id, ``score``), equal scores by ascending id.

    An item without terms, or whose terms no document has, gets no row. Every row of ``items`` is
    an item, whatever its id; documents that share an id and a score share ranks in some order.
    Null is smaller than all other ids. Items are worked on in groups with at most ``TOGETHER``
    terms (or one item), whose terms and weights travel with the tasks.
    """
    spark = items.sparkSession
    asked = materialize(items.select(F.monotonically_increasing_id().alias("qid"), items[id_col].alias("id"), items[text_col].cast("string").alias("text")), "items")
    wanted = materialize(asked.mapInArrow(tidy(_asked), "qid long, term binary"), "terms")
    groups = max(1, -(-wanted.count() // TOGETHER))
    parts = [_group(index, wanted.where(F.pmod(F.xxhash64("qid"), F.lit(groups)) == g), k) for g in range(groups)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    named = out.join(asked.select("qid", "id"), "qid").select(F.col("id").alias(id_col), F.col("place").alias("rank"), id_of("ord").alias(doc_id), "score")
    return materialize(named, "ranked", lasting=True)


def _group(index: Index, wanted: DataFrame, k: int) -> DataFrame:
    spark = wanted.sparkSession
    terms = wanted.select("term").distinct()
    held = materialize(index.rows.where("term is not null").join(terms, "term"), "postings")
    df = {bytes(r.term): r.df for r in held.groupBy("term").agg(F.sum("df").alias("df")).collect()}
    weight = spark.createDataFrame([(t, i, n) for i, (t, n) in enumerate(sorted(df.items()))], "term binary, tno int, df long")
    w = F.floor(1000 * F.log(F.lit(2 * index.documents + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
    plans: dict[int, list[tuple[int, int]]] = {}
    for r in wanted.join(weight, "term").select("qid", "tno", w.alias("w")).where("w > 0").collect():  # at most TOGETHER rows, or one item's
        plans.setdefault(r.qid, []).append((r.tno, r.w))
    hits = held.join(weight.select("term", "tno"), "term").select("shard", F.lit(1).alias("kind"), "tno", "pos", "q", "cl", "mx")
    none = F.lit(None).cast("int")
    heads = index.rows.where("term is null").select("shard", F.lit(0).alias("kind"), none.alias("tno"), "pos", "q", "cl", "mx")
    whole = materialize(hits.unionByName(heads), "hits")
    together = lambda rows: rows.repartitionById(index.shards, F.col("shard")).sortWithinPartitions("shard", "kind")
    lean = whole.withColumn("q", F.lit(None).cast("binary")).withColumn("pos", F.when(F.col("kind") == 0, F.col("pos")))
    left = materialize(together(lean).mapInArrow(tidy(_bound(plans)), "qid long, shard int, best long"), "bounds")
    found = None
    last = F.lit(1)
    for visits in VISITS:
        if found is not None:
            lowest = found.where(F.col("place") == k).select("qid", F.col("score").alias("last"))
            left = left.drop("last").join(lowest, "qid", "left")
            last = F.coalesce("last", F.lit(1))
        near = left.where(F.col("best") >= last).withColumn("least", last.cast("long"))
        if visits is not None:
            near = near.withColumn("turn", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("best"), "shard"))).where(F.col("turn") <= visits)
        near = materialize(near.select("shard", "qid", "least"), "visits")
        if near.isEmpty():
            break
        empty = {c: F.lit(None).cast(t) for c, t in (("tno", "int"), ("pos", "binary"), ("q", "binary"), ("cl", "binary"), ("mx", "binary"))}
        calls = near.select("shard", F.lit(2).alias("kind"), *(v.alias(c) for c, v in empty.items()), "qid", "least")
        there = whole.join(near.select("shard").distinct(), "shard", "left_semi").select("*", F.lit(None).cast("long").alias("qid"), F.lit(None).cast("long").alias("least"))
        new = together(there.unionByName(calls)).mapInArrow(tidy(_visit(plans, k)), "qid long, score long, ord long")
        new = new if found is None else new.unionByName(found.select("qid", "score", "ord"))
        place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "ord"))
        found = materialize(new.withColumn("place", place).where(F.col("place") <= k), "found")
        left = materialize(left.join(near.select("qid", "shard"), ["qid", "shard"], "left_anti").select("qid", "shard", "best"), "left")
    return found if found is not None else spark.createDataFrame([], "qid long, score long, ord long, place int")


def rank(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``build`` and ``search`` in one; the index goes afterwards."""
    small_batches(docs.sparkSession)
    with scratch(docs.sparkSession):
        return search(build(docs), items, k)


def oracle(k: int = 50) -> str:
    """The query's rows as DuckDB SQL."""
    words = lambda table, key: f"SELECT {key}, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM {table}"
    return f"""
WITH t AS (SELECT doc_id, term, count(*) AS tf FROM ({words("documents", "doc_id")}) GROUP BY ALL),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM t GROUP BY doc_id),
c AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM d),
f AS (SELECT term, count(*) AS df FROM t GROUP BY term),
q AS (SELECT DISTINCT item_id, term FROM ({words("benchmark", "item_id")})),
w AS (SELECT item_id, term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM q JOIN f USING (term), c),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * nn) // ll)))) AS BIGINT) AS score FROM w JOIN t USING (term) JOIN d USING (doc_id), c GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= {k}"""
