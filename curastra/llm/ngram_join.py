"""Exact Jaccard self-join of documents as sets of word shingles, by set relations.

1. Count shingles over all documents in one pass; those in many documents come last in the
   global order of shingles, all others are ordered by hash.
2. Index each set by its prefix in that order: sets over the threshold share a prefix
   shingle. An index list holds (size, position, set), sorted so. Equal sets are one. Of lists
   that hold the same sets only the first in the order is kept: it has their smallest positions.
3. Walk the lists by blocks of entries. Pairs of blocks whose sizes, or what is left behind
   their positions, can't reach the threshold are skipped as a whole, and so are the rest of
   a list once sizes differ too much, blocks of one component, and whole runs of such. Long
   lists are dealt out to units of parts that meet; those of one component have no unit.
4. Answers are derived from those of similar sets: lists are first walked only along
   neighbours, then only against the set with the most answers so far. What these linked is
   one component, and the last, complete walk only looks at pairs of different components.
   So a list of near copies that are one component costs time linear in its length. The
   complete walk gives a pair in the first list that holds both, as far as their first
   lists tell, not in each of them.

Candidates pass a parity sketch, a lower bound of the symmetric difference; whole sets are
fetched for those that pass only. Links that the sketch makes likely take part in the
first walks at once. A spanning forest of them is verified, again where links were refuted. Then
the lists are walked for the likeliest pairs of two components in each, and a forest of them is
verified, so linked groups don't meet in all their pairs. The complete walk knows verified
components only. In the end each candidate pair is in one component, or refuted by its sketches
or whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, order_key, release, scratch, slices, small_batches, text_buffer, tidy

#: Bits of the parity sketches: the power of two over four times the set's size, within these.
SKETCHES = 512, 65536
#: Bits of the sketch in an index list: enough to tell unrelated sets of up to 1400 shingles apart.
MINI = 512
#: A shingle in more than this share of all documents is ordered last. There are at most
#: (mean shingles of a document) / COMMON such shingles, whatever the number of documents:
#: 8 bytes each, 20 MB for documents of 500 words that share nothing else.
COMMON = 1 / 5000
#: Documents (of up to 500 shingles in the mean) whose shingles are counted together.
COUNTED = 10_000
#: How far neighbours in an index list are looked at in the first walk.
REACH = 8
#: Entries of a block of an index list, and of a list beyond which it is dealt out to several tasks.
ENTRIES, HOT = 64, 16_384
#: How often what walks before the last have found is tried, where other links were refuted.
AGAIN = 2
#: Of how many of its first lists a set knows the names.
FIRST = 8
#: Bytes of text hashed at a time, index rows walked at a time.
BLOCK, ROWS = 1_000_000, 100_000

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_TOP = np.uint64(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M[1]
    x = (x ^ (x >> np.uint64(29))) * _M[2]
    return x ^ (x >> np.uint64(32))


def _tables():
    rng = np.random.default_rng(6)
    value = rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
    value[65:91] = value[97:123]  # A-Z as a-z
    blank = np.zeros(256, dtype=bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    value[blank] = 0
    return value, blank


def _word_hashes(data: np.ndarray, value: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word in the bytes."""
    inside = ~blank[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    start = np.flatnonzero(first)
    if not len(start):
        return start, np.zeros(0, dtype=np.uint64)
    place = np.arange(len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))[: len(data)] if start[0] == 0 else None
    if place is None:
        place = np.zeros(len(data), dtype=np.int64)
        place[start[0] :] = np.arange(start[0], len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))
    place[~inside] = 0
    power = np.full(int(place.max()) + 1, _M[0], dtype=np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    return start, _mix(np.add.reduceat(value[data] * power[place], start))


def shingle_sets(raw, start, size, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(text's index, sorted distinct 63-bit shingle hashes) of every text that has words."""
    value, blank = _tables()
    i, n = 0, len(size)
    while i < n:
        j, total = i, 0
        while j < n and (j == i or total + size[j] < BLOCK):
            total += int(size[j]) + 1
            j += 1
        data = np.full(total, 32, dtype=np.uint8)
        at = np.cumsum(size[i:j] + 1) - size[i:j] - 1
        for k, a in enumerate(at.tolist()):
            s = int(start[i + k])
            data[a : a + int(size[i + k])] = raw[s : s + int(size[i + k])]
        w_start, h = _word_hashes(data, value, blank)
        bound = np.searchsorted(w_start, np.append(at, total))
        m = max(len(h) - words + 1, 0)
        s = h[:m]
        for k in range(1, words):
            s = _mix(s * _M[3] + h[k : m + k])
        for k in range(j - i):
            a, b = int(bound[k]), int(bound[k + 1])
            if b - a >= words:
                yield i + k, np.unique(s[a : b - words + 1] & ~_TOP)
            elif b > a:
                x = np.full(1, b - a, dtype=np.uint64)
                for y in h[a:b]:
                    x = _mix(x * _M[3] + y)
                yield i + k, x & ~_TOP
        i = j


def _count_common(words: int):
    """(token, n): how many of each ``COUNTED`` documents have a shingle, where it is more than one."""

    def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
        least = max(2, len(sets) * COMMON / 2)
        token = np.concatenate(sets)
        sets.clear()
        token.sort()  # in place: the tokens are much of a worker's memory
        start = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
        n = np.diff(np.append(start, len(token)))
        keep = n >= least
        return pa.RecordBatch.from_arrays([pa.array(token[start[keep]].astype(np.int64)), pa.array(n[keep])], names=["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in slices(batches):
            for _, s in shingle_sets(*text_buffer(batch.column("text")), words):
                held.append(s)
                size += len(s)
            if len(held) >= COUNTED or size >= 500 * COUNTED:
                yield counted(held)
                size = 0
        if held:
            yield counted(held)

    return run


def _ordered(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The set in the global order: common shingles get the top bit."""
    if len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        hit = common[at] == s
        if hit.any():
            return np.sort(np.where(hit, s | _TOP, s))
    return s


def _node(s: np.ndarray) -> int:
    return int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketch(s: np.ndarray) -> bytes:
    """For each residue of the hashes, whether an odd number of the set has it."""
    bits = min(max(1 << (4 * len(s)).bit_length(), SKETCHES[0]), SKETCHES[1])
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _mini(s: np.ndarray) -> bytes:
    """The sketch of fixed size that goes along in index lists."""
    odd = np.bincount((s & np.uint64(MINI - 1)).astype(np.int64), minlength=MINI) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _apart(x: bytes, y: bytes) -> tuple[int, int]:
    """(bits that differ, bits) of two sketches; the longer one is folded."""
    x, y = (np.frombuffer(v, dtype=np.uint8) for v in (x, y))
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64)), 8 * len(x)


def _describe(words: int, percent: int, common: np.ndarray):
    """Per document: its set's id and size; once in a batch for a set its prefix and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n = batch.num_rows
            node, size = [None] * n, [0] * n
            prefix, sketch, mini, seen = [None] * n, [None] * n, [None] * n, set()
            for i, s in shingle_sets(*text_buffer(batch.column("text")), words):
                node[i], size[i] = _node(s), len(s)
                if node[i] not in seen:
                    seen.add(node[i])
                    sketch[i], mini[i] = _sketch(s), _mini(s)
                    prefix[i] = _ordered(s, common)[: len(s) - (percent * len(s) + 99) // 100 + 1].tobytes()
            names = ["ord", "node", "n", "prefix", "sketch", "mini"]
            yield pa.RecordBatch.from_arrays([batch.column("ord"), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(prefix, pa.binary()), pa.array(sketch, pa.binary()), pa.array(mini, pa.binary())], names=names)

    return run


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, start, size = text_buffer(batch.column("prefix"))
        count = size // 8
        if not count.sum():
            continue
        tokens = np.concatenate([raw[a : a + b] for a, b in zip(start.tolist(), size.tolist(), strict=True)]).view(np.int64)
        node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), count)
        n = np.repeat(batch.column("n").to_numpy(zero_copy_only=False), count)
        pos = np.arange(len(tokens)) - np.repeat(np.cumsum(count) - count, count)
        for i in range(0, len(tokens), ROWS):
            s = slice(i, i + ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(x[s]) for x in (tokens, n, node, pos)], names=["token", "n", "node", "pos"])


def _values(column: pa.Array) -> np.ndarray:
    """Numbers as they are, sketches as rows of 64-bit words."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def _lists(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[np.ndarray]]:
    """Columns of whole index lists, about ROWS rows at a time; rows come sorted by token."""
    held, rows = [], 0
    for batch in batches:
        held.append([_values(batch.column(k)) for k in names])
        rows += batch.num_rows
        if rows >= ROWS:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(cols[0], cols[0][-1], side="left"))
            if cut:
                yield [x[:cut] for x in cols]
            held = [[x[cut:] for x in cols]]
            rows = 0
    if held:
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        if len(cols[0]):
            yield cols


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of several sets, each set once; at the first of a list what tells its sets (128 bits)."""
    names = ["token", "n", "node", "pos"]
    for token, n, node, pos in _lists(batches, names):
        once = np.ones(len(token), dtype=bool)
        once[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        token, n, node, pos = (x[once] for x in (token, n, node, pos))
        same = np.zeros(len(token), dtype=bool)
        same[1:] = token[1:] == token[:-1]
        keep = same | np.append(same[1:], False)
        token, n, node, pos = (x[keep] for x in (token, n, node, pos))
        if not len(token):
            continue
        first = np.append(True, token[1:] != token[:-1])
        start = np.flatnonzero(first)
        told = []
        for m in _M[:2]:
            total = np.zeros(len(token), dtype=np.int64)
            total[start] = np.add.reduceat(_mix(node.view(np.uint64) * m + m), start).view(np.int64)
            told.append(pa.array(total, mask=~first))
        yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (token, n, node, pos)), *told], names=[*names, "one", "two"])


def _first_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, first): the names of a set's first lists, 0 where it has fewer; rows come sorted by set and position."""
    for node, token in _lists(batches, ["node", "token"]):
        start = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        count = np.diff(np.append(start, len(node)))
        k = np.arange(FIRST)
        names = np.where(k < count[:, None], token[np.minimum(start[:, None] + k, len(node) - 1)], 0)
        yield pa.RecordBatch.from_arrays([pa.array(node[start]), pa.array([x.tobytes() for x in names], pa.binary())], names=["node", "first"])


def _need(x, y, percent: int):
    """Least intersection of sets of sizes x and y."""
    return -(-percent * (x + y) // (100 + percent))


def _blocks(token, n, left, comp):
    """Lists cut into blocks of up to ``ENTRIES``: (start, end, blocks to the end of the run, mixed), by block.

    A run of a list is a block's length or more of entries of one component; cuts are at its ends, too.
    """
    at = np.arange(len(token))
    first = np.append(True, token[1:] != token[:-1])
    change = first | np.append(True, comp[1:] != comp[:-1])
    starts = np.flatnonzero(change)
    length = np.diff(np.append(starts, len(token)))
    long = np.repeat(length >= ENTRIES, length)
    forced = first | (change & (long | np.append(False, long[:-1])))
    begin = np.maximum.accumulate(np.where(forced, at, 0))
    start = np.flatnonzero((at - begin) % ENTRIES == 0)
    end = np.append(start[1:], len(token))
    mixed = np.maximum.reduceat(comp, start) != np.minimum.reduceat(comp, start)
    # blocks of a run have one number, others each their own
    run = np.where(long[start], begin[start], -1 - start)
    last = np.flatnonzero(np.append(run[1:] != run[:-1], True))
    skip = np.repeat(last, np.diff(np.append(-1, last))) - np.arange(len(start))
    return start, end, skip, mixed


def _block_pairs(token, n, left, comp, percent):
    """Places (i, j) of list entries to compare: within blocks, then of pairs of blocks that may hold a link.

    Entries of a list are sorted by size and position. A pair of blocks is skipped if its sizes or
    what is left behind its positions can't reach the threshold, or if both are of one component;
    the rest of a list is skipped once sizes differ too much, a run of one component at once.
    """
    start, end, skip, mixed = _blocks(token, n, left, comp)
    block = np.repeat(np.arange(len(start)), end - start)
    i, k = np.flatnonzero(mixed[block]), 0
    while len(i):
        k += 1
        i = i[i + k < len(token)]
        i = i[(block[i + k] == block[i]) & (100 * n[i] >= percent * n[i + k])]
        yield i, i + k
    low, high, best = n[start], n[end - 1], np.maximum.reduceat(left, start)
    of, ends = token[start], comp[start]
    grid = np.arange(ENTRIES)
    x, k = np.arange(len(start)), 0
    while len(x):
        k += 1
        x = x[x + skip[x] + k < len(start)]
        y = x + skip[x] + k
        on = (of[x] == of[y]) & (100 * high[x] >= percent * low[y])
        x, y = x[on], y[on]
        ok = 1 + np.minimum(best[x], best[y]) >= _need(low[x], low[y], percent)
        ok &= mixed[x] | mixed[y] | (ends[x] != ends[y])
        for c in range(0, int(ok.sum()), ENTRIES):
            a, b = x[ok][c : c + ENTRIES], y[ok][c : c + ENTRIES]
            i, j = (start[a][:, None] + grid)[:, :, None], (start[b][:, None] + grid)[:, None, :]
            i, j = np.broadcast_arrays(i, j)
            inside = (i < end[a][:, None, None]) & (j < end[b][:, None, None])
            yield i[inside], j[inside]


def _meetings(mode, every, head, token, n, left, comp, deg, percent):
    """Places (i, j) of list entries to compare, many at a time."""
    if mode == "hub":
        by = np.lexsort((-deg, head))
        hub = by[np.searchsorted(head[by], head)]  # the first of each list has the most links
        i = every[hub != every]
        yield hub[i], i
        return
    if mode in ("best", "all"):
        yield from _block_pairs(token, n, left, comp, percent)
        return
    i = every
    for k in range(1, REACH + 1):
        i = i[i + k < len(token)]
        i = i[(token[i + k] == token[i]) & (100 * n[i] >= percent * n[i + k])]  # the list's rest is larger still
        yield i, i + k
    i = every[head != every]
    yield head[i], i


def _units(walked: DataFrame, hot: DataFrame, mode: str) -> DataFrame:
    """Rows of lists, where those of ``hot`` (token, m) lists are dealt out to units of about ``HOT`` entries.

    Neighbours and hubs are looked for within parts of a list, other parts for each shingle. All pairs
    of a list: its largest component has no pairs of its own, so its parts meet those of the rest
    only, and parts of the rest meet each other. A list of one component has no unit.
    """
    rows = walked.join(hot, "token", "left")
    if mode in ("chain", "hub"):
        part = F.pmod(F.xxhash64("node", "token"), F.ceil(F.col("m") / HOT))
        return rows.withColumn("token", F.when(F.col("m").isNull(), F.col("token")).otherwise(F.xxhash64("token", part))).drop("m")
    by_comp = rows.where("m is not null").groupBy("token", "comp").agg(F.count("*").alias("k"))
    top = by_comp.groupBy("token").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("of"))
    top = top.select("token", F.col("top.comp").alias("big"), F.ceil(F.col("top.k") / HOT).alias("cd"), F.ceil((F.col("of") - F.col("top.k")) / HOT).alias("cr"))
    rows = rows.join(materialize(top, "hot"), "token", "left")
    own = F.xxhash64("node")
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")

    def parts(n):
        return F.when(F.col(n) > 0, F.sequence(zero, F.col(n) - 1)).otherwise(none)

    large, small = F.pmod(own, F.col("cd")), F.pmod(own, F.greatest("cr", F.lit(1)))  # none is zero
    across = F.transform(parts("cr"), lambda q: F.xxhash64("token", F.lit("across"), large, q))
    met = F.transform(parts("cd"), lambda p: F.xxhash64("token", F.lit("across"), p, small))
    rest = F.transform(parts("cr"), lambda q: F.xxhash64("token", F.lit("rest"), F.least(small, q), F.greatest(small, q)))
    keys = F.when(F.col("big").isNull(), F.array("token")).when(F.col("comp") == F.col("big"), across).otherwise(F.concat(met, rest))
    return rows.select(F.explode(keys).alias("token"), *(c for c in walked.columns if c != "token"))


def _walk(mode: str, percent: int):
    """Candidate pairs of the lists: along neighbours, against each list's hub, the likeliest of two components, or all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, name, n, node, pos, comp, deg, mini, first in _lists(batches, ["token", "list", "n", "node", "pos", "comp", "deg", "mini", "first"]):
            left = n - pos - 1

            def able(i, j, name=name, n=n, comp=comp, left=left, mini=mini, first=first):
                lo, hi = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
                need = _need(lo, hi, percent)
                ok = np.flatnonzero((comp[i] != comp[j]) & (100 * lo >= percent * hi) & (1 + np.minimum(left[i], left[j]) >= need))
                differ = np.bitwise_count(mini[i[ok]] ^ mini[j[ok]]).sum(axis=1, dtype=np.int64)
                able = lo[ok] + hi[ok] - 2 * need[ok] >= differ
                ok, apart = ok[able], differ[able] / (lo + hi)[ok[able]]
                if mode != "all":  # which wants each pair once
                    return ok, apart
                x = first[i[ok]]
                both = ((x[:, :, None] == first[j[ok]][:, None, :]).any(axis=2)) & (x != 0)
                known = x[np.arange(len(x)), both.argmax(axis=1)]  # the first list of both, if it is among the first of each
                once = ~both.any(axis=1) | (known == name[i[ok]].view(np.uint64))
                return ok[once], apart[once]

            head = np.maximum.accumulate(np.where(np.append(True, token[1:] != token[:-1]), np.arange(len(token)), 0))
            every = np.arange(len(token))
            found, kept = [], 0
            for i, j in _meetings(mode, every, head, token, n, left, comp, deg, percent):
                ok, apart = able(i, j)
                i, j = i[ok], j[ok]
                if mode == "best":
                    of = np.lexsort((apart, np.maximum(comp[i], comp[j]), np.minimum(comp[i], comp[j])))
                    i, j = i[of], j[of]
                    lo, hi = np.minimum(comp[i], comp[j]), np.maximum(comp[i], comp[j])
                    new = np.append(True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))[: len(i)]
                    i, j = i[new], j[new]
                a, b = node[i], node[j]
                found.append((np.minimum(a, b), np.maximum(a, b)))
                kept += len(a)
                if kept > 4 * ROWS:
                    yield _edges(found)
                    found, kept = [], 0
            if found:
                yield _edges(found)

    return run


def _edges(found) -> pa.RecordBatch:
    """Distinct pairs."""
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    o = np.lexsort((b, a))
    a, b = a[o], b[o]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return pa.RecordBatch.from_arrays([pa.array(a[new]), pa.array(b[new])], names=["a", "b"])


def _sketched(percent: int):
    """Pairs whose sketches leave room for the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            differ, bits = np.array([_apart(x, y) for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist(), strict=True)]).T
            na, nb = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("na", "nb"))
            keep = na + nb - 2 * _need(na, nb, percent) >= differ
            apart = -bits / 2 * np.log1p(-np.minimum(2 * differ / bits, 0.999))  # the likely symmetric difference
            likely = (na + nb - apart) / (na + nb + apart)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).filter(pa.array(keep)) for k in ("a", "b")), pa.array(likely[keep])], names=["a", "b", "likely"])

    return run


def _whole_sets(words: int):
    """Sets of the wanted nodes, from their documents' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            want = batch.column("node").to_pylist()
            node, found = [], []
            for i, s in shingle_sets(*text_buffer(batch.column("text")), words):
                if _node(s) == want[i]:  # another row with the same id may have another text
                    node.append(want[i])
                    found.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(found, pa.binary())], names=["node", "set"])

    return run


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = (np.frombuffer(v.as_py(), dtype=np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])

    return run


_ACROSS = "a long, b long, likely double, ca long, cb long"


def _thin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidates (a, b, likely, ca, cb): of those that join the same components, a forest of the likeliest."""
    for frame in frames:
        if len(frame):
            frame = frame.sort_values(["likely", "a", "b"], ascending=[False, True, True])
            lo, hi = np.minimum(frame["ca"], frame["cb"]), np.maximum(frame["ca"], frame["cb"])
            frame = frame.assign(lo=lo, hi=hi).drop_duplicates(["lo", "hi"])
            parent: dict[int, int] = {}

            def root(x, parent=parent):
                while (p := parent.get(x, x)) != x:
                    parent[x] = parent.get(p, p)
                    x = p
                return x

            keep = []
            for x, y in zip(frame["lo"].tolist(), frame["hi"].tolist(), strict=True):
                x, y = root(x), root(y)
                keep.append(x != y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
            frame = frame[keep]
        yield frame[["a", "b", "likely", "ca", "cb"]]


def _pair(df: DataFrame, other: DataFrame, cols: dict[str, str], key: str) -> DataFrame:
    return df.join(other.select(F.col("node").alias(key), *(F.col(k).alias(v) for k, v in cols.items())), key)


def links(docs: DataFrame, words: int, percent: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(documents as rows (ord, node, n), links between different sets that span all components)."""
    spark = docs.sparkSession
    small_batches(spark)
    text = docs.select(order_key(docs[id_col]).alias("ord"), docs[text_col].cast("string").alias("text"))
    rows = text.count()
    counted = text.select("text").mapInArrow(tidy(_count_common(words)), "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") > F.lit(rows * COMMON)).select("token").toArrow()  # 8 bytes each, see COMMON
    common = np.sort(found.column("token").to_numpy().astype(np.int64).view(np.uint64))

    described = materialize(text.mapInArrow(tidy(_describe(words, percent, common)), "ord long, node long, n long, prefix binary, sketch binary, mini binary"), "sets")
    index = described.where("prefix is not null").select("node", "n", "prefix").mapInArrow(tidy(_postings), "token long, n long, node long, pos long")
    every = materialize(index.repartition("token").sortWithinPartitions("token", "n", "node").mapInArrow(tidy(_shared), "token long, n long, node long, pos long, one long, two long"), "lists")
    last = F.lit(-(2**63))  # tokens are ordered as unsigned numbers
    other = every.where("one is not null").groupBy("one", "two").agg(F.min(F.col("token").bitwiseXOR(last)).bitwiseXOR(last).alias("token"))
    shared = materialize(every.select("token", "n", "node", "pos").join(other.select("token"), "token", "left_semi"), "index")
    release(spark)

    first = shared.select("node", "pos", "token").repartition("node").sortWithinPartitions("node", "pos").mapInArrow(tidy(_first_lists), "node long, first binary")
    sketch = materialize(described.where("prefix is not null").groupBy("node").agg(F.min("ord").alias("ord"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("mini").alias("mini")).join(first, "node"), "sketches")

    hot = materialize(shared.groupBy("token").agg(F.count("*").alias("m")).where(F.col("m") > HOT), "hot")
    any_hot = not hot.isEmpty()

    def candidates(mode: str, label: DataFrame) -> DataFrame:
        # distinct pairs of different components within the sketch's bound, with the likely similarity
        walked = shared.join(sketch.select("node", "mini", "first"), "node").join(label, "node", "left")
        walked = walked.select("token", F.col("token").alias("list"), "n", "node", "pos", F.coalesce("comp", "node").alias("comp"), F.coalesce("deg", F.lit(0)).alias("deg"), "mini", "first")
        if any_hot:
            walked = _units(walked, hot, mode)
        pairs = walked.repartition("token").sortWithinPartitions("token", "n", "pos", "comp", "node").mapInArrow(tidy(_walk(mode, percent)), "a long, b long").distinct()
        both = _pair(_pair(pairs, sketch, {"n": "na", "sketch": "sa"}, "a"), sketch, {"n": "nb", "sketch": "sb"}, "b")
        out = materialize(both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(_sketched(percent), "a long, b long, likely double"), "pairs")
        release(spark)
        return out

    def across(pairs: DataFrame, label: DataFrame) -> DataFrame:
        # those that join different components, which are named
        at = label.select("node", "comp")
        named = pairs.join(at.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left").join(at.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
        return named.select("a", "b", "likely", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb")

    def spanning(pairs: DataFrame) -> DataFrame:
        # a forest of each task's pairs, then of those that meet by component
        return pairs.mapInPandas(_thin, _ACROSS).repartition(F.least("ca", "cb"), F.greatest("ca", "cb")).mapInPandas(_thin, _ACROSS).select("a", "b")

    def labelled(edges: DataFrame) -> DataFrame:
        return components(edges).withColumnRenamed("component", "comp").withColumn("deg", F.lit(0))

    def with_links(label: DataFrame, edges: DataFrame) -> DataFrame:
        degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("deg"))
        return materialize(label.drop("deg").join(degree, "node", "left"), "degrees")

    label = spark.createDataFrame([], "node long, comp long, deg long")
    likely = None
    for mode in ("chain", "hub"):
        new = across(candidates(mode, label).where(F.col("likely") >= percent / 100), label)
        likely = new if likely is None else likely.unionByName(new)
        label = labelled(likely)
        if mode == "chain":
            label = with_links(label, likely)
    # from here on, links have to be confirmed: first forests of what is likely, then of the likeliest
    # pairs of two components, so that those of linked groups aren't all listed, then all other pairs
    alone = likely.select("a", "b", "likely", F.col("a").alias("ca"), F.col("b").alias("cb"))
    known = materialize(alone.select("a", "b", "likely"), "known")
    tree = materialize(spanning(alone), "tree")

    def whole(nodes: DataFrame) -> DataFrame:
        owner = sketch.join(nodes, "node", "left_semi").select("ord", "node")
        out = materialize(text.join(owner, "ord").mapInArrow(tidy(_whole_sets(words)), "node long, set binary"), "whole")
        release(spark)
        return out

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()

    sets = whole(ends(tree))

    def verdicts(pairs: DataFrame) -> DataFrame:
        both = _pair(_pair(pairs.select("a", "b"), sets, {"set": "sa"}, "a"), sets, {"set": "sb"}, "b")
        out = materialize(both.select("a", "b", "sa", "sb").mapInArrow(tidy(_verify(percent)), "a long, b long, ok boolean"), "verdicts")
        release(spark)
        return out

    def unknown(pairs: DataFrame) -> DataFrame:
        return across(pairs, label).join(judged, ["a", "b"], "left_anti")

    judged = verdicts(tree)
    label = labelled(judged.where("ok"))
    for mode in (None, "best"):
        if mode:
            known = candidates(mode, label)
            sets = sets.unionByName(whole(ends(known).join(sets.select("node"), "node", "left_anti")))
        for _ in range(AGAIN):
            more = verdicts(spanning(unknown(known)))
            judged = judged.unionByName(more)
            if more.where("ok").isEmpty():
                break
            label = labelled(judged.where("ok"))
    pairs = candidates("all", label)
    sets = sets.unionByName(whole(ends(pairs).join(sets.select("node"), "node", "left_anti")))
    judged = judged.unionByName(verdicts(spanning(unknown(pairs))))
    label = labelled(judged.where("ok"))
    rest = verdicts(unknown(pairs))
    if not rest.where("ok").isEmpty():
        label = labelled(judged.unionByName(rest).where("ok"))
    return described.select("ord", "node", "n"), label.select("node", F.col("comp"))


def similar_groups(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of documents with Jaccard similarity of at least ``percent`` in 100, exactly.

    A-Z are lower-cased; words are runs of other bytes than blanks (tab to carriage return,
    space); a set has the distinct runs of ``words`` words, or all words as one element if
    there are fewer. Returns a row (``doc_id``, ``n_shingles``, ``component_id``) for every
    input row: the smallest id reachable by links, the document included. A null or wordless
    text has an empty set and links with nothing. A null id is smaller than all others and
    gives a null ``component_id`` to its group. Repeated rows each get a row.
    """
    with scratch(docs.sparkSession):
        member, label = links(docs, words, percent, id_col, text_col)
        named = member.join(label, "node", "left").select("ord", "n", F.coalesce("comp", "node").alias("comp"))
        named = materialize(named, "members", lasting=True)
    release(docs.sparkSession)
    least = named.where("comp is not null").groupBy("comp").agg(F.min("ord").alias("least"))
    out = named.join(least, "comp", "left").select("ord", "n", F.coalesce("least", "ord").alias("least"))
    null = F.lit(-(2**63))
    return out.select(F.when(F.col("ord") != null, F.col("ord")).alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("least") != null, F.col("least")).alias("component_id"))
