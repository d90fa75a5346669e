"""Exact removal of repeated passages by prefix-free parsing and suffix arrays.

The corpus is parsed into phrases at rolling-hash triggers. A 32-byte window is a trigger
if its hash is the smallest in some run of windows that fits in ``length`` bytes; so every
string of ``length`` bytes holds a trigger, equal strings hold the same one at the same
place, and a run of string starts that share a trigger is a *phrase* (with the bytes that
its last string still needs, so no phrase needs its neighbours).

* The **parse** is the list of phrase occurrences. Ordered by (trigger, phrase hash,
  document, start) it tells which occurrence of a phrase comes first in the corpus; all
  later ones repeat it wholly.
* The **dictionary** holds one first occurrence for each phrase. Only triggers that occur
  in several different phrases need their bytes: their suffixes of at least ``length``
  bytes are sorted into a suffix array, equal neighbours in which are strings that start
  in several phrases. Together with the parse's order that gives the corpus order.

All strings that are compared have ``length`` bytes and lie in one phrase with its overlap, so
the order of suffixes beyond a phrase (a suffix array of the parse) is never asked for: from the
parse only the order of occurrences is taken.

A trigger decides the shuffle key, so equal strings always meet in a task. Triggers that have
a fair share of all rows (a passage in many contexts; found by counting on a sample first) are
dealt out by phrase instead, then by the hash of each string; so are triggers that turn out
to have more phrases than a task should sort. Either way finds the same strings.

Cost: one shuffle of 40 bytes for about every 35 bytes of text, one of the text itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_of, materialize, order_key, release, slices, sliding_min, small_batches, text_buffer, tidy

#: Bytes of a trigger window; five doublings of the rolling hash.
TRIGGER = 32
#: Low bits of the sort key that hold a position; the rest is the rolling hash.
PLACE_BITS = 22
#: Bytes hashed at a time; less than 2 ** PLACE_BITS.
BLOCK = 1_000_000
#: Different phrases at one trigger, over which they are dealt out by string: both ways find the
#: same strings, but a task has to hold all phrases of a trigger for a suffix array.
CROWDED = 4096
#: Rows given out, and strings sorted, at a time.
ROWS, STRINGS = 100_000, 150_000
#: Triggers are counted by this many bits of their hash on so many documents; over this share, and
#: this number, of the rows a bucket's triggers are dealt out by phrase and then by string.
BUCKET_BITS, SAMPLE, HOT_SHARE, HOT_LEAST = 16, 50_000, 1 / 2000, 64
#: Crowded triggers that are sent to all tasks (8 bytes each); more are joined.
FEW = 100_000

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_PLACE = np.uint64(2**PLACE_BITS - 1)


def _byte_table() -> np.ndarray:
    """A random odd 64-bit value for each byte."""
    return np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


def rolling_hash(data: np.ndarray, table: np.ndarray, width: int = TRIGGER) -> np.ndarray:
    """Hash of the ``width`` (a power of two) bytes from each position on."""
    h, k, level = table[data], 1, 0
    while k < width:
        x = h[:-k] * _ODD[level % 5]
        x ^= x >> np.uint64(31)
        x += h[k:]
        h, k, level = x, 2 * k, level + 1
    h = h * _ODD[5]
    h ^= h >> np.uint64(32)
    return h


# A long holds where a phrase's strings start: lo (31 bits), number of starts less one (8), kind (8).
# Sorting by it sorts by lo.
def _pack(lo, span, kind):
    return (lo << 16) | (span << 8) | kind


def _lo(meta):
    return meta >> 16


def _span(meta):
    return (meta >> 8) & 0xFF


def _kind(meta):
    return meta & 0xFF


def _mix(x):
    x = x.view(np.uint64) * _ODD[0]
    return (x ^ (x >> np.uint64(29))) * _ODD[1]


def phrases(raw: np.ndarray, start: np.ndarray, size: np.ndarray, length: int, table: np.ndarray):
    """Phrases of several texts: (trigger hash, phrase hash, text's index, lo, span)."""
    pieces = []  # (text, from, to): what is hashed together stays under BLOCK; long texts overlap
    for i in np.flatnonzero(size >= length).tolist():
        for at in range(0, int(size[i]) - length + 1, BLOCK):
            pieces.append((i, at, min(at + BLOCK + length - 1, int(size[i]))))
    out, i = [], 0
    while i < len(pieces):
        j, n = i, 0
        while j < len(pieces) and (n == 0 or n + pieces[j][2] - pieces[j][1] <= BLOCK):
            n += pieces[j][2] - pieces[j][1]
            j += 1
        own = np.array(pieces[i:j], dtype=np.int64)
        ln = own[:, 2] - own[:, 1]
        at = np.cumsum(ln) - ln
        data = np.concatenate([raw[start[t] + a : start[t] + b] for t, a, b in pieces[i:j]])
        h = rolling_hash(data, table)
        key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        trigger = (sliding_min(key, length - TRIGGER + 1) & _PLACE).astype(np.int64)  # of the string from each position on
        n = len(trigger)
        valid = np.ones(n, dtype=bool)
        edge = np.zeros(n + 1, dtype=bool)
        for e in (at + ln)[:-1].tolist():
            valid[e - length + 1 : e] = False
            edge[e] = True
        new = np.ones(n, dtype=bool)
        new[1:] = (trigger[1:] != trigger[:-1]) | (valid[1:] != valid[:-1]) | edge[1:n]
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:], n) - 1
        lo, hi = lo[valid[lo]], hi[valid[lo]]
        trig, end = trigger[lo], hi + length
        piece = np.searchsorted(at, lo, side="right") - 1
        e = (trig - lo).astype(np.uint64) * _ODD[0] + (end - lo).astype(np.uint64) * _ODD[1]
        steps = -(-(2 * length) // TRIGGER) // 2 + 1
        for k in range(steps):  # windows that together cover the phrase from both its ends
            for q in (np.minimum(lo + k * TRIGGER, end - TRIGGER), np.maximum(end - (k + 1) * TRIGGER, lo)):
                e = (e ^ h[q]) * _ODD[2]
                e ^= e >> np.uint64(30)
        out.append((h[trig].view(np.int64), e.view(np.int64), own[piece, 0], lo - at[piece] + own[piece, 1], hi - lo))
        i = j
    if not out:
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(5))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _firsts(g, e, ord_, meta):
    """Sorted rows: (first row of each (g, e), True where a row is later than its first)."""
    new = np.ones(len(g), dtype=bool)
    new[1:] = (g[1:] != g[:-1]) | (e[1:] != e[:-1])
    head = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    later = (ord_ != ord_[head]) | (_lo(meta) != _lo(meta[head]))
    return new, later


_PARSE = "g long, e long, ord long, tag long, meta long"
_PARSE_FIELDS = ["g", "e", "ord", "tag", "meta"]
_FOUND = "g long, ord long, tag long, meta long, k int"
#: Kinds of rows: to be resolved; the same at a hot trigger; repeats; a trigger's different phrases; strings to deal out.
_SEEK, _HOT, _REPEAT, _PHRASE, _CROWD = range(5)


def _batch(names, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=names)


def _longs(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(k).to_numpy(zero_copy_only=False) for k in names]


def _bucket(g: np.ndarray) -> np.ndarray:
    return (_mix(g) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _count_triggers(length: int):
    """How many different phrases of each batch have a trigger of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, count = _byte_table(), np.zeros(2**BUCKET_BITS, dtype=np.int64)
        for batch in slices(batches):
            g, e, *_ = phrases(*text_buffer(batch.column("text")), length, table)
            _, one = np.unique(_mix(g) ^ e.view(np.uint64), return_index=True)
            count += np.bincount(_bucket(g[one]), minlength=2**BUCKET_BITS)
        at = np.flatnonzero(count)
        yield _batch(["bucket", "n"], at, count[at])

    return run


def _hot_buckets(keyed: DataFrame, length: int) -> np.ndarray:
    """Buckets of triggers with so many rows that one task shouldn't get them.

    Judged on about ``SAMPLE`` documents, chosen by hash. That only decides how rows are dealt to
    tasks: any choice gives the same result. There are at most 1 / ``HOT_SHARE`` of them.
    """
    stride = max(1, keyed.select("ord").count() // SAMPLE)
    some = keyed.where(F.pmod(F.xxhash64("ord", "tag"), F.lit(stride)) == 0).select("text")
    counted = some.mapInArrow(tidy(_count_triggers(length)), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counted = counted.toArrow()  # at most 2 ** BUCKET_BITS rows
    bucket, n = (counted.column(k).to_numpy() for k in ("bucket", "n"))
    return np.sort(bucket[n > max(HOT_LEAST, n.sum() * HOT_SHARE)])


def _parse(length: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, is_hot = _byte_table(), np.zeros(2**BUCKET_BITS, dtype=bool)
        is_hot[hot] = True
        for batch in slices(batches):
            raw, start, size = text_buffer(batch.column("text"))
            ord_, tag = _longs(batch, "ord", "tag")
            g, e, text, lo, span = phrases(raw, start, size, length, table)
            crowd = is_hot[_bucket(g)]
            g = np.where(crowd, (_mix(g) ^ e.view(np.uint64)).view(np.int64), g)  # dealt out by phrase
            ord_, tag, meta = ord_[text], tag[text], _pack(lo, span, np.where(crowd, _HOT, _SEEK))
            o = np.lexsort((tag, meta, ord_, e, g))
            g, e, ord_, tag, meta = g[o], e[o], ord_[o], tag[o], meta[o]
            _, later = _firsts(g, e, ord_, meta)
            # what repeats within the batch is decided here, so few rows of a hot phrase are shuffled
            meta = np.where(later, (meta & ~0xFF) | _REPEAT, meta)
            g = np.where(later, _mix(ord_ + meta).view(np.int64), g)
            e = np.where(later, 0, e)
            for i in range(0, len(g), ROWS):
                s = slice(i, i + ROWS)
                yield _batch(_PARSE_FIELDS, g[s], e[s], ord_[s], tag[s], meta[s])

    return run


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (g, e, ord, meta, tag): repeats, and the first of each phrase of triggers that have several.

    Rows that share an id may have a phrase at the same place in different texts: all of these
    are first ones. ``k`` counts a trigger's first ones. Between batches only the first row of the
    last phrase is held, so it doesn't matter how many rows or phrases a trigger has.
    """
    names = ["g", "ord", "tag", "meta", "k"]
    held, held_k, told = None, 0, False  # the last phrase's first row, the last count, whether the row was given out
    for batch in batches:
        cols = _longs(batch, *_PARSE_FIELDS)
        done = _kind(cols[4]) == _REPEAT
        if done.any():
            n = int(done.sum())
            yield _batch(names, np.zeros(n, dtype=np.int64), *(x[done] for x in cols[2:]), np.zeros(n, dtype=np.int32))
            cols = [x[~done] for x in cols]
        if not len(cols[0]):
            continue
        if held is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(held, cols, strict=True)]
        g, e, ord_, tag, meta = cols
        new, later = _firsts(g, e, ord_, meta)
        again = np.append(False, ~new[1:] & (ord_[1:] == ord_[:-1]) & (meta[1:] == meta[:-1]) & (tag[1:] == tag[:-1]))
        first = np.flatnonzero(~later & ~again)
        own = g[first]
        fresh = np.append(True, own[1:] != own[:-1])
        k = np.arange(len(first)) - np.maximum.accumulate(np.where(fresh, np.arange(len(first)), 0))
        if held is not None:
            k[np.cumsum(fresh) == 1] += held_k
        hot = _kind(meta[first]) == _HOT
        wanted = (k > 0) | hot | np.append(own[1:] == own[:-1], False)
        give = wanted.copy()
        if told:
            give[0], wanted[0] = False, True
        at = first[give]
        out_meta = np.append((meta[later] & ~0xFF) | _REPEAT, (meta[at] & ~0xFF) | np.where(hot[give], _CROWD, _PHRASE))
        zero = np.zeros(int(later.sum()), dtype=np.int64)
        if len(out_meta):
            yield _batch(names, np.append(zero, g[at]), np.append(ord_[later], ord_[at]), np.append(tag[later], tag[at]), out_meta, np.append(zero, np.minimum(k[give], 2**30)).astype(np.int32))
        head = int(np.flatnonzero(new)[-1])
        held, held_k, told = [x[head : head + 1] for x in cols], int(k[-1]), bool(wanted[np.searchsorted(first, head)])


def _strings(length: int):
    """Bytes of the dictionary's phrases: rows (g, ord, tag, meta, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, start, _ = text_buffer(batch.column("text"))
            ord_, tag = _longs(batch, "ord", "tag")
            wants = batch.column("wants")
            bounds = np.asarray(wants.offsets)
            n = np.diff(bounds)
            g, meta = (wants.values.field(k).to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]] for k in ("g", "meta"))
            row = np.repeat(np.arange(len(n)), n)
            at = start[row] + _lo(meta)
            for i in range(0, len(row), ROWS):
                s = slice(i, i + ROWS)
                found = [raw[a:b].tobytes() for a, b in zip(at[s].tolist(), (at[s] + _span(meta[s]) + length).tolist(), strict=True)]
                yield _batch(["g", "ord", "tag", "meta", "phrase"], g[s], ord_[row[s]], tag[row[s]], meta[s], pa.array(found, pa.binary()))

    return run


def _windows(column: pa.Array, meta: np.ndarray, length: int):
    """Every string of the phrases: (phrase's index, start in it, the strings as rows of bytes)."""
    raw, start, _ = text_buffer(column)
    n = _span(meta) + 1
    row = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    view = np.lib.stride_tricks.sliding_window_view(raw, length)
    return row, at, np.ascontiguousarray(view[start[row] + at])


def _runs(row, at, meta):
    """Neighbouring starts in a phrase as one row each: (phrase's index, meta of the run)."""
    if not len(row):
        return row, row
    o = np.lexsort((at, row))
    row, at = row[o], at[o]
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1)
    s = np.flatnonzero(new)
    n = np.append(s[1:], len(row)) - s
    return row[s], _pack(_lo(meta[row[s]]) + at[s], n - 1, _REPEAT)


def _suffix_array(length: int):
    """Phrases sorted by trigger: where strings start that also start earlier in the corpus."""

    def decide(table: pa.Table):
        table = table.combine_chunks()
        column = table.column("phrase").chunk(0)
        ord_, tag, meta = (table.column(k).to_numpy() for k in ("ord", "tag", "meta"))
        row, at, strings = _windows(column, meta, length)
        # the dictionary's suffix array: its suffixes in order, to the depth that counts
        order = np.argsort(strings.view(f"S{length}").ravel(), kind="stable")
        strings = strings[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (strings[1:] != strings[:-1]).any(axis=1)
        rank = np.cumsum(new) - 1
        # the parse's order within equal suffixes
        o_ord, o_at = ord_[row[order]], (_lo(meta[row]) + at)[order]
        by = np.lexsort((o_at, o_ord, rank))
        head = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
        f_ord, f_at = o_ord[by][head], o_at[by][head]
        later = (o_ord[by] != f_ord) | (o_at[by] != f_at)
        hit = order[by[later]]
        row, runs = _runs(row[hit], at[hit], meta)
        return _batch(["ord", "tag", "meta"], ord_[row], tag[row], runs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, strings = [], 0
        for batch in slices(batches, rows=1_000, column="phrase"):
            held.append(batch)
            strings += int((_span(batch.column("meta").to_numpy()) + 1).sum())
            if strings >= STRINGS:
                table = pa.Table.from_batches(held)
                g = table.column("g").to_numpy()
                cut = int(np.searchsorted(g, g[-1], side="left"))  # a trigger's phrases stay together; there are at most CROWDED
                if cut:
                    yield decide(table.slice(0, cut))
                held = table.slice(cut).combine_chunks().to_batches()
                strings = sum(int((_span(b.column("meta").to_numpy()) + 1).sum()) for b in held)
        if held:
            yield decide(pa.Table.from_batches(held))

    return run


def _by_string(length: int):
    """Strings of crowded triggers, keyed by two hashes of the whole string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = np.random.default_rng(7).integers(1, 2**63, (2, length), dtype=np.uint64) | np.uint64(1)
        for batch in slices(batches, rows=1_000, column="phrase"):
            ord_, tag, meta = _longs(batch, "ord", "tag", "meta")
            row, at, strings = _windows(batch.column("phrase"), meta, length)
            g, e = [], []
            for i in range(0, len(row), 10_000):
                part = strings[i : i + 10_000].astype(np.uint64) + np.uint64(1)
                for keep, m in ((g, odd[0]), (e, odd[1])):
                    x = part * m
                    x ^= x >> np.uint64(29)
                    x = (x * _ODD[3]).sum(axis=1, dtype=np.uint64)
                    x ^= x >> np.uint64(32)
                    keep.append((x * _ODD[4]).view(np.int64))
            g, e = np.concatenate(g), np.concatenate(e)
            o_ord, o_tag, o_meta = ord_[row], tag[row], _pack(_lo(meta[row]) + at, 0, _SEEK)
            o = np.lexsort((o_tag, o_meta, o_ord, e, g))
            g, e, o_ord, o_tag, o_meta = g[o], e[o], o_ord[o], o_tag[o], o_meta[o]
            _, later = _firsts(g, e, o_ord, o_meta)
            seek = ~later
            yield _batch(_PARSE_FIELDS, g[seek], e[seek], o_ord[seek], o_tag[seek], o_meta[seek])
            # strings that repeat within the batch are known to; neighbours go as one row
            phrase, runs = _runs(row[o[later]], at[o[later]], meta)
            own = ord_[phrase]
            yield _batch(_PARSE_FIELDS, _mix(own + runs).view(np.int64), np.zeros(len(own), dtype=np.int64), own, tag[phrase], runs)

    return run


def repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", crowded: int = CROWDED) -> DataFrame:
    """Runs of string starts that also start earlier: rows (ord, tag, meta), see ``_pack``."""
    small_batches(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    parse = keyed.mapInArrow(tidy(_parse(length, _hot_buckets(keyed, length))), _PARSE)
    sorted_ = parse.repartition("g").sortWithinPartitions("g", "e", "ord", "meta", "tag")
    found = materialize(sorted_.mapInArrow(tidy(_resolve), _FOUND), "parse")
    release(docs.sparkSession)
    kind = F.col("meta").bitwiseAND(F.lit(0xFF))
    whole = found.where(kind == _REPEAT).select("ord", "tag", "meta")

    wants = found.where(kind > _REPEAT).groupBy("ord", "tag").agg(F.collect_list(F.struct("g", "meta")).alias("wants"))
    dictionary = materialize(keyed.join(wants, ["ord", "tag"]).mapInArrow(tidy(_strings(length)), "g long, ord long, tag long, meta long, phrase binary"), "dictionary")
    release(docs.sparkSession)
    plain, crowd = dictionary.where(kind == _PHRASE), dictionary.where(kind == _CROWD)
    many = found.where((kind == _PHRASE) & (F.col("k") >= crowded)).select("g").distinct()
    n = many.limit(FEW + 1).count()
    if n:
        many = F.broadcast(many) if n <= FEW else many
        crowd = crowd.unionByName(plain.join(many, "g", "left_semi"))
        plain = plain.join(many, "g", "left_anti")
    out = whole.unionByName(plain.repartition("g").sortWithinPartitions("g").mapInArrow(tidy(_suffix_array(length)), "ord long, tag long, meta long"))
    strings = crowd.select("ord", "tag", "meta", "phrase").mapInArrow(tidy(_by_string(length)), _PARSE)
    dealt = strings.repartition("g").sortWithinPartitions("g", "e", "ord", "meta", "tag").mapInArrow(tidy(_resolve), _FOUND)
    return out.unionByName(dealt.where(kind == _REPEAT).select("ord", "tag", "meta"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(ord, tag, text): ``tag`` tells apart texts of rows that share an id."""
    rows = docs.select(order_key(docs[id_col]).alias("ord"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    return rows.select("ord", F.xxhash64("text").alias("tag"), "text")


def _cut(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, start, size = text_buffer(batch.column("text"))
            runs = batch.column("runs")
            flat, bounds = runs.values.to_numpy(zero_copy_only=False), np.asarray(runs.offsets)
            has = np.asarray(runs.is_valid())
            removed, spans, digest, kept = [], [], [], []
            for i in range(batch.num_rows):
                data = raw[start[i] : start[i] + size[i]]
                meta = np.unique(flat[bounds[i] : bounds[i + 1]]) if has[i] else flat[:0]
                if len(meta):
                    lo, end = _lo(meta), np.maximum.accumulate(_lo(meta) + _span(meta) + length)
                    new = np.append(True, lo[1:] > end[:-1])
                    lo, end = lo[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
                    gaps = zip(np.append(0, end).tolist(), np.append(lo, size[i]).tolist(), strict=True)
                    rest = b"".join(data[a:b].tobytes() for a, b in gaps)
                    removed.append(int((end - lo).sum()))
                    spans.append(len(lo))
                else:
                    rest = data.tobytes()
                    removed.append(0)
                    spans.append(0)
                digest.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode("utf-8", "ignore") if with_text else None)
            names = ["ord", "rest", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield _batch(names, batch.column("ord"), batch.column("rest"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string()))

    return run


def dedup_passages(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, crowded: int = CROWDED) -> DataFrame:
    """Remove every byte covered by a string of ``length`` bytes that also starts earlier.

    Earlier means a smaller id, or the same id and an earlier start; both are judged on the
    input. Texts are UTF-8 bytes; a null text is empty. A null id is smaller than all others.
    Rows that share an id and a start count as one place, so of wholly repeated rows none
    removes the other. Texts shorter than ``length`` lose nothing; an empty table gives one.

    Texts of any length are parsed in blocks. Returns the input's other columns (but the text) and ``n_bytes``, ``n_removed``,
    ``n_spans`` (maximal removed runs), ``kept_sha256`` of the remaining bytes and ``kept``,
    the remaining text, in which characters that a cut has split are left out (null unless
    ``keep_text``). Input columns with those names are replaced.
    """
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    others = [c for c in docs.columns if c not in (id_col, text_col, *names)]
    runs = repeats(docs, length, id_col, text_col, crowded).groupBy("ord", "tag").agg(F.collect_list("meta").alias("runs"))
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(order_key(docs[id_col]).alias("ord"), F.xxhash64(text).alias("tag"), text.alias("text"), F.struct(*(docs[c] for c in others), F.lit(0).alias("_")).alias("rest"))
    joined = rows.join(runs, ["ord", "tag"], "left").select("ord", "rest", "text", "runs")
    rest = joined.schema["rest"].dataType.simpleString()
    cut = joined.mapInArrow(tidy(_cut(length, keep_text)), f"ord long, rest {rest}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string")
    return cut.select(id_of("ord").alias(id_col), *(F.col("rest")[c].alias(c) for c in others), *names)
