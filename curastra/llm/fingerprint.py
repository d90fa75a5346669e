"""Document fingerprints of improbable features.

Every 32-byte window of a text has an entropy. How rare an entropy is in the corpus ranks
the windows: a histogram over all documents, taken in a first pass, gives rank 0 to the
rarest. The lowest-ranked of each 32 neighbouring windows (fewer at a text's ends) gains a
point of popularity; windows with enough points are the text's features, so every text of a
window or more has some; a shorter one is a window by itself. Features are hashed into Bloom
filters of 256 bytes, a new filter beginning after 160 features. Two fingerprints are compared
filter by filter: shared bits beyond those expected by chance, over the most there could be,
take the best partner for each filter of the shorter chain, and are averaged.

Window entropies come from a running sum: a window loses one byte and gains one, and what
that changes depends on how often the byte occurs in the 31 others. Long texts are worked on
in overlapping blocks.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_of, order_key, slices, sliding_min, small_batches, text_buffer, tidy

WINDOW = 32
#: Windows among which the rarest gains popularity, and the popularity of a feature.
NEIGHBOURS, POPULAR = 32, 8
#: Bits of a filter, bits set by a feature, features in a filter.
BITS, PROBES, FEATURES = 2048, 5, 160
#: Entropies are told apart to so many steps.
STEPS = 1000
#: Bytes of text worked on at a time; about those of a range of documents in ``compare_with_next``.
BLOCK, RANGE = 500_000, 64_000_000

_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _gain() -> np.ndarray:
    """n log n, less (n-1) log (n-1), in fixed point; by n."""
    n = np.arange(WINDOW + 1, dtype=np.float64)
    f = np.round(n * np.log2(np.maximum(n, 1)) * 2**16).astype(np.int64)
    return np.diff(f, prepend=0)


def entropy_steps(data: np.ndarray) -> np.ndarray:
    """Entropy of every window as a step from 0 to STEPS."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, dtype=np.int64)
    behind, ahead = np.zeros(n, dtype=np.uint8), np.zeros(n, dtype=np.uint8)
    for lag in range(1, WINDOW):
        same = (data[lag:] == data[:-lag]).view(np.uint8)
        behind[lag:] += same
        ahead[:-lag] += same
    gain = _gain()
    counts = np.bincount(data[:WINDOW], minlength=256)
    first = int(np.round(counts * np.log2(np.maximum(counts, 1)) * 2**16).astype(np.int64).sum())
    # window s+1 against s: byte s goes (with the count of its equals in the window), the byte after the window comes
    change = gain[1 + behind[WINDOW:].astype(np.int64)] - gain[1 + ahead[: n - WINDOW].astype(np.int64)]
    total = first + np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(change)])
    most = 5 * WINDOW * 2**16  # the entropy of 32 different bytes is 5 bits
    return np.clip((most - total) * STEPS // most, 0, STEPS)


def _windows(raw, start, size):
    """Groups of windows of the texts: (bytes, steps of all windows in them, text, place in the text and whether it counts, of each).

    Windows at the ends of a block are there as neighbours only. Texts without a window are left
    out. A step is -1 where a window isn't in one text.
    """
    pieces = []  # text, bytes from, to, windows from, to
    for i, n in enumerate(size.tolist()):
        for p in range(0, n - WINDOW + 1, BLOCK):
            q = min(p + BLOCK, n - WINDOW + 1)
            pieces.append((i, max(0, p - NEIGHBOURS + 1), min(n, q + NEIGHBOURS + WINDOW - 2), p, q))
    i = 0
    while i < len(pieces):
        j, total = i, 0
        while j < len(pieces) and (j == i or total + pieces[j][2] - pieces[j][1] <= BLOCK):
            total += pieces[j][2] - pieces[j][1]
            j += 1
        text, a, b, p, q = np.array(pieces[i:j], dtype=np.int64).T
        data = np.concatenate([raw[start[t] + x : start[t] + y] for t, x, y, _, _ in pieces[i:j]])
        at = np.cumsum(b - a) - (b - a)
        steps = entropy_steps(data)
        for e in at[1:].tolist():
            steps[max(0, e - WINDOW + 1) : e] = -1
        piece = np.repeat(np.arange(j - i), b - a)[: len(steps)]
        place = np.arange(len(steps)) - (at - a)[piece]
        yield data, steps, text[piece], (place >= p[piece]) & (place < q[piece]) & (steps >= 0)
        i = j


def _histogram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count = np.zeros(STEPS + 1, dtype=np.int64)
    for batch in slices(batches):
        for _, steps, _, own in _windows(*text_buffer(batch.column("text"))):
            count += np.bincount(steps[own], minlength=STEPS + 1)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(STEPS + 1)), pa.array(count)], names=["step", "n"])


def _steps(docs: DataFrame, text_col: str) -> dict[int, int]:
    """How many windows of all documents have each entropy step."""
    counted = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(tidy(_histogram), "step long, n long").groupBy("step").agg(F.sum("n").alias("n"))
    return dict.fromkeys(range(STEPS + 1), 0) | {r.step: r.n for r in counted.collect()}  # STEPS + 1 rows


def rarity(docs: DataFrame, text_col: str = "text") -> list[int]:
    """Rank of each entropy step, 0 for the rarest over all windows of all documents."""
    return _ranked(_steps(docs, text_col))


def _ranked(n: dict[int, int]) -> list[int]:
    order = sorted(n, key=lambda s: (n[s], s))
    rank = [0] * (STEPS + 1)
    for r, s in enumerate(order):
        rank[s] = r
    return rank


def _hash(features: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes, a multiple of 8."""
    words = np.ascontiguousarray(features).view(np.uint64)
    h = np.full(len(words), _M[0], dtype=np.uint64)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * _M[1]
        h ^= h >> np.uint64(29)
    h *= _M[2]
    return h ^ (h >> np.uint64(32))


def features(raw, start, size, rank: np.ndarray) -> list[np.ndarray]:
    """Feature hashes of each text in order, each once."""
    found: list[list[np.ndarray]] = [[] for _ in size]
    far, pad = np.int64(2**62), np.full(NEIGHBOURS - 1, 2**62, dtype=np.int64)
    for data, steps, text, own in _windows(raw, start, size):
        # between two texts there are as many windows that don't count as there are further neighbours
        key = np.where(steps >= 0, (rank[steps] << 32) | np.arange(len(steps)), far)
        low = sliding_min(np.concatenate([pad, key, pad]), NEIGHBOURS)  # leftmost of the rarest
        votes = np.bincount(low[low < far] & 0xFFFFFFFF, minlength=len(steps))
        place = np.flatnonzero((votes >= POPULAR) & own)
        got = _hash(np.lib.stride_tricks.sliding_window_view(data, WINDOW)[place])
        bounds = [0, *(np.flatnonzero(np.diff(text[place])) + 1).tolist(), len(place)] if len(place) else [0]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            found[text[place[a]]].append(got[a:b])
    out = []
    for i, parts in enumerate(found):
        if 0 < size[i] < WINDOW:  # a window by itself
            whole = np.zeros((1, WINDOW), dtype=np.uint8)
            whole[0, : size[i]] = raw[start[i] : start[i] + size[i]]
            parts = [_hash(whole)]
        got = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
        if len(got) > 1:
            _, first = np.unique(got, return_index=True)
            got = got[np.sort(first)]
        out.append(got)
    return out


def chain(hashes: np.ndarray) -> np.ndarray:
    """Bloom filters, a row of bytes each, of feature hashes in order."""
    if not len(hashes):
        return np.zeros((0, BITS // 8), dtype=np.uint8)
    filters = -(-len(hashes) // FEATURES)
    bits = np.zeros((filters, BITS), dtype=np.uint8)
    row = np.arange(len(hashes)) // FEATURES
    for k in range(PROBES):
        bits[row, ((hashes >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1)


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """0 to 1 for two chains: 1 if equal, 0 if just one is empty or what is shared is chance."""
    if x.shape == y.shape and (x == y).all():
        return 1.0
    if not len(x) or not len(y):
        return 0.0
    if len(x) > len(y):
        x, y = y, x
    nx, ny = (np.bitwise_count(v).sum(axis=1, dtype=np.int64) for v in (x, y))
    best = np.zeros(len(x))
    for i in range(len(x)):
        shared = np.bitwise_count(x[i] & y).sum(axis=1, dtype=np.int64)
        chance = nx[i] * ny / BITS
        most = np.minimum(nx[i], ny)
        best[i] = np.max(np.where(most > chance, np.clip((shared - chance) / np.maximum(most - chance, 1e-9), 0, 1), 0))
    return float(best.mean())


def as_text(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode()


def from_text(fingerprint: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(fingerprint), dtype=np.uint8).reshape(-1, BITS // 8)


def _fingerprints(rank: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, start, size = text_buffer(batch.column("text"))
            out = [as_text(chain(h)) for h in features(raw, start, size, rank)]
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(out, pa.string())], names=["rest", "fingerprint"])

    return run


def fingerprint(docs: DataFrame, text_col: str = "text", rank: list[int] | None = None) -> DataFrame:
    """Adds ``fingerprint`` (base64 of the chain of filters) to every row.

    Equal texts have equal fingerprints under the same ``rank`` (by default the corpus's own);
    a null or empty text has an empty one. Rows are kept as they are; no shuffle. Long texts take
    memory for a block and their features.
    """
    others = [c for c in docs.columns if c != "fingerprint"]
    small_batches(docs.sparkSession)
    table = np.array(rank if rank is not None else rarity(docs, text_col), dtype=np.int64)
    rows = docs.select(F.struct(*(docs[c] for c in others)).alias("rest"), docs[text_col].cast("string").alias("text"))
    out = rows.mapInArrow(tidy(_fingerprints(table)), f"rest {rows.schema['rest'].dataType.simpleString()}, fingerprint string")
    return out.select(*(F.col("rest")[c].alias(c) for c in others), "fingerprint")


def _compare(rank: np.ndarray):
    """Rows sorted by (bucket, ahead, ord, text): each document against its edited text and the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (bucket, ord, text, chain) of the document that waits for its next
        names = ["ord", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        for batch in slices(batches):
            raw, start, size = text_buffer(batch.column("text"))
            own = [chain(h) for h in features(raw, start, size, rank)]
            bucket, ord_, ahead = (batch.column(k).to_pylist() for k in ("bucket", "ord", "ahead"))
            texts = batch.column("text").to_pylist()
            pairs = []
            for i in range(batch.num_rows):
                here = (bucket[i], ord_[i], texts[i] or "", own[i])
                if held is not None and held[0] == bucket[i]:
                    pairs.append((held, here))
                    held = None if ahead[i] else here
                else:  # further rows ahead belong to no one
                    held = None if ahead[i] else here
            edited = []
            for d, nxt in pairs:
                half = len(d[2]) // 2
                edited.append((d[2][: len(d[2]) - half] + nxt[2][:half]).encode())
            length = np.array([len(e) for e in edited], dtype=np.int64)
            joined = np.frombuffer(b"".join(edited), dtype=np.uint8)
            chains = [chain(h) for h in features(joined, np.cumsum(length) - length, length, rank)]
            cols = [
                pa.array([d[1] for d, _ in pairs], pa.int64()),
                pa.array([len(d[2]) for d, _ in pairs], pa.int64()),
                pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                pa.array([as_text(d[3]) for d, _ in pairs], pa.string()),
                pa.array([as_text(c) for c in chains], pa.string()),
                pa.array([likeness(d[3], c) for (d, _), c in zip(pairs, chains, strict=True)], pa.float64()),
                pa.array([likeness(d[3], n[3]) for d, n in pairs], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against a text half replaced by the next document's start, and the next.

    Documents are in order of id (null first; rows with one id by text); after the last comes
    the first. The last floor(n_chars / 2) characters are replaced by as many (or all) of the
    next document's first. Returns id, ``n_chars``, ``edited_sha256``, ``fingerprint``,
    ``edited_fingerprint``, ``near_edited`` and ``near_next``; a null text is empty; the only
    document of a table is its own next; an empty table gives no row.

    Ids are cut into ranges of about ``RANGE`` bytes of text, a task each, so that tasks don't
    grow with the table; there are as many as shuffle partitions at least. Texts are shuffled
    once, by range, and each range's first row goes to the range before, too. Only ids are looked
    at for that. The driver holds a few numbers for each range.
    """
    spark = docs.sparkSession
    small_batches(spark)
    windows = _steps(docs, text_col)
    rank = np.array(_ranked(windows), dtype=np.int64)
    rows = docs.select(order_key(docs[id_col]).alias("ord"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    size = sum(windows.values()) + WINDOW * rows.count()  # bytes of all texts, rather too many
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE))
    cuts = rows.stat.approxQuantile("ord", [i / parts for i in range(1, parts)], 1 / (4 * parts)) if parts > 1 else []
    cuts = sorted({int(c) for c in cuts})
    bound = F.array(*(F.lit(c) for c in cuts)) if cuts else F.array().cast("array<long>")
    bucket = F.size(F.filter(bound, lambda c: c <= F.col("ord")))
    heads = sorted((r.bucket, r.head) for r in rows.select(bucket.alias("bucket"), "ord").groupBy("bucket").agg(F.min("ord").alias("head")).collect())  # a row for each range
    # the range before each head; the first row goes behind the last range
    back = spark.createDataFrame([(head, heads[k - 1][0]) for k, (_, head) in enumerate(heads)], "ord long, back int")
    placed = rows.withColumn("bucket", bucket).join(F.broadcast(back), "ord", "left")
    to = F.array_compact(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("ahead")), F.when(F.col("back").isNotNull(), F.struct(F.col("back").alias("bucket"), F.lit(1).alias("ahead")))))
    dealt = placed.withColumn("to", F.explode(to)).select("to.bucket", "to.ahead", "ord", "text")
    dealt = dealt.repartitionById(len(cuts) + 1, F.col("bucket")).sortWithinPartitions("bucket", "ahead", "ord", "text")
    kinds = "ord long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(tidy(_compare(rank)), kinds).withColumn("ord", id_of("ord")).withColumnRenamed("ord", id_col)
