"""Packing of tokenized documents into windows by Karmarkar-Karp multiway differencing.

A document's ids are cut into full windows and a remainder. Remainders are gathered until
they fill some hundred windows, then dealt to those windows: each remainder starts as a
partial partition (itself, 0, ..., 0); the two partial partitions with the largest spreads
are merged so that large sums meet small ones, until one is left. If a window exceeds the
capacity, the number of windows rises by one and the differencing starts anew.

One remainder in four is first halved again and again; such small pieces level the windows
to a few tokens. Everything happens in the task that reads the documents: no shuffle, and
memory for one group of remainders, whatever the size of the table.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import byte_letters
from .common import MEMOS, id_of, order_key, slices, small_batches, tidy

#: Windows that are filled together.
GROUP = 320
#: Whole remainders, of which one is cut finely.
FINE_EVERY = 4
#: Smallest of the fine pieces, in tokens.
FINEST = 4
#: Words, and pre-tokens, that a worker remembers before it begins anew; as many older ones are kept.
REMEMBERED = 150_000
#: Longer ones (in characters) are not remembered.
LONG = 64
#: Characters of text whose words are looked up together.
BLOCK = 4_000_000
#: The vocabulary's pre-tokens.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def differencing(sizes: list[int], windows: int) -> np.ndarray:
    """The window of each size, by multiway differencing."""
    n = len(sizes)
    if windows == 1 or n == 0:
        return np.zeros(n, dtype=np.int64)
    zero = np.zeros(windows, dtype=np.int64)
    queue, children = [], []
    for i, size in enumerate(sizes):
        sums = zero.copy()
        sums[0] = size
        queue.append((-size, i, sums))
    heapq.heapify(queue)
    while len(queue) > 1:
        _, a, x = heapq.heappop(queue)
        _, b, y = heapq.heappop(queue)
        sums = x + y[::-1]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        sums -= sums[-1]
        node = n + len(children)
        children.append((a, b, order))
        heapq.heappush(queue, (-int(sums[0]), node, sums))
    at: dict[int, np.ndarray] = {queue[0][1]: np.arange(windows)}
    out = np.zeros(n, dtype=np.int64)
    for node in range(n + len(children) - 1, n - 1, -1):  # a merged partition comes after its parts
        place = at.pop(node)
        a, b, order = children[node - n]
        first = np.empty(windows, dtype=np.int64)
        first[order] = place
        for child, own in ((a, first), (b, first[::-1])):
            if child < n:
                out[child] = own[0]
            else:
                at[child] = own
    if not children:
        out[0] = 0
    return out


def fill(sizes: list[int], capacity: int) -> tuple[np.ndarray, int]:
    """(window of each size, number of windows): the fewest near-equal windows that differencing can fill."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        at = differencing(sizes, windows)
        if np.bincount(at, weights=sizes, minlength=windows).max() <= capacity:
            return at, windows
        windows += 1


def fine(length: int) -> list[int]:
    """A length cut into halves, quarters and so on."""
    out = []
    while length > 2 * FINEST:
        out.append(length // 2)
        length -= length // 2
    return [*out, length]


class _Memo(dict):
    """A dict that computes what it lacks; when full, it keeps what it had as a second choice."""

    def __init__(self, compute, size: int):
        self.compute, self.size, self.before = compute, size, {}

    def __missing__(self, key: str) -> bytes:
        value = self.before.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= LONG:
            if len(self) >= self.size:
                self.before = dict(self)
                self.clear()
            self[key] = value
        return value


class WordTokenizer:
    """Ids of texts, word by word.

    The vocabulary's pre-tokenizer drops white space and no pre-token holds any, so the ids
    of a text are those of its words in order. The words of many texts are split and told
    apart in Arrow; only different ones are looked up, and what is known of them is remembered.
    A new word of plain Latin letters, which the normalizer only lower-cases, is cut into
    pre-tokens, which repeat even more; only new ones are given to the library's model. A
    word with other characters goes to the library as it is.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.letters = byte_letters()
        self.odd = re.compile("[^!-~\u00a1-\u012f\u0131-\u024f]|<\\|").search
        self.cut = regex.compile(PRETOKEN).findall
        self.words, self.pieces = _Memo(self._word, remembered), _Memo(self._piece, remembered)

    def _piece(self, piece: str) -> bytes:
        own = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        return array("I", [t.id for t in self.model.tokenize(own)]).tobytes()

    def _word(self, word: str) -> bytes:
        if word.isascii() or not self.odd(word):  # most new words are letters, or letters and a stop
            if word.isalpha():
                return self.pieces[word.lower()]
            if word.endswith((",", ".")) and word[:-1].isalpha():
                return self.pieces[word[:-1].lower()] + self.pieces[word[-1]]
        if self.odd(word):
            return array("I", self.library.encode(word, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.pieces.__getitem__, self.cut(word.lower())))

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's begin, and the end)."""
        split = pc.split_pattern(pc.replace_substring_regex(pc.fill_null(texts, ""), "[\n\t\r]", " "), " ")
        words = split.flatten().dictionary_encode()
        different = pa.ListArray.from_arrays(pa.array([0, len(words.dictionary)], pa.int32()), words.dictionary)
        known = list(map(self.words.__getitem__, pc.binary_join(different, " ")[0].as_py().split(" ")))  # faster than word by word
        size = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        flat = np.frombuffer(b"".join(known), dtype="<u4")
        at = words.indices.to_numpy()
        count = size[at]
        end = np.append(0, np.cumsum(count))
        place = np.repeat((np.cumsum(size) - size)[at] - end[:-1], count)
        place += np.arange(len(place))
        bounds = np.asarray(split.offsets)
        return flat[place], end[bounds - bounds[0]]

    def encode(self, text: str) -> bytes:
        """Packed little-endian unsigned 32-bit ids of a text."""
        return self.documents(pa.array([text]))[0]

    def documents(self, texts: pa.Array) -> list[bytes]:
        """Packed ids of each text; of a very long one the words are looked up in parts."""
        if len(texts) == 1:
            text = texts[0].as_py() or ""
            found, at = [], 0
            while at < len(text):
                end = text.find(" ", at + BLOCK)
                end = len(text) if end < 0 else end
                found.append(self.encode_all(pa.array([text[at:end]]))[0].tobytes())
                at = end
            return [b"".join(found)]
        ids, bounds = self.encode_all(texts)
        return [ids[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


#: Tokenizers of this worker by path and memory; what one task has remembered serves the next.
_READY: dict[tuple[str, int], WordTokenizer] = {}
MEMOS["packing"] = _READY.clear


def _tokenizer(path: str, remembered: int) -> WordTokenizer:
    if (path, remembered) not in _READY:
        _READY[path, remembered] = WordTokenizer(path, remembered)
    return _READY[path, remembered]


_NAMES = ["ord", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]


def _pack(path: str, capacity: int, end_id: int, with_ids: bool, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path, remembered)
        end = end_id.to_bytes(4, "little")
        sequence = TaskContext.get().partitionId() << 33
        cols: list[list] = [[] for _ in _NAMES]
        held: list[tuple] = []  # remainders' pieces: (ord, start, length, crc, tokens, ids)
        total = 0

        def put(ord_, start, length, crc, tokens, at, offset, ids):
            for c, v in zip(cols, (ord_, start, length, crc, tokens, at, offset, ids), strict=True):
                c.append(v)

        def flush():
            nonlocal sequence, held, total
            at, windows = fill([p[2] for p in held], capacity)
            used = [0] * windows
            for (ord_, start, length, crc, tokens, ids), w in zip(held, at.tolist(), strict=True):
                put(ord_, start, length, crc, tokens, sequence + w, used[w], ids)
                used[w] += length
            sequence += windows
            held, total = [], 0

        def batch_of():
            out = pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1], pa.list_(pa.int32()))], names=_NAMES)
            for c in cols:
                c.clear()
            return out

        def piece(data, a, b):
            part = data[4 * a : 4 * b]
            return zlib.crc32(part), np.frombuffer(part, dtype="<u4").astype(np.int32) if with_ids else None

        for batch in slices(batches, size=BLOCK):
            for ord_, data in zip(batch.column("ord").to_pylist(), tokenizer.documents(batch.column("text")), strict=True):
                data += end
                tokens = len(data) // 4
                at = 0
                while tokens - at >= capacity:
                    crc, own = piece(data, at, at + capacity)
                    put(ord_, at, capacity, crc, tokens, sequence, 0, own)
                    sequence += 1
                    at += capacity
                if at < tokens:
                    total += tokens - at
                    for length in fine(tokens - at) if ord_ % FINE_EVERY == 0 else [tokens - at]:
                        crc, own = piece(data, at, at + length)
                        held.append((ord_, at, length, crc, tokens, own))
                        at += length
                    # windows can be filled to about three tokens; wait until that is what is left
                    if total >= GROUP * capacity and (-total) % capacity <= 3 * GROUP or total >= 2 * GROUP * capacity:
                        flush()
                        if len(cols[0]) >= 10_000 or with_ids:
                            yield batch_of()
        if held:
            flush()
        if cols[0]:
            yield batch_of()

    return run


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, remembered: int = REMEMBERED) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens with little padding.

    A document is its text's ids without special tokens, then ``end_id``; a null text is just
    ``end_id``. Each id lies in exactly one piece. Returns one row for each piece: id,
    ``start`` (the document's ids before it), ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset`` (in the sequence, without gaps from 0) and ``ids`` (null
    unless ``with_ids``). Null ids and repeated rows are packed like any others; an empty
    table gives no row. Sequence ids tell partitions apart, so read the documents from
    files or sort them within partitions: then a repeated task packs them the same way.
    ``remembered`` words are known to a worker at a time (some 200 bytes each); it changes
    the time, not the result. Very long texts are encoded in parts, cut at spaces.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(order_key(docs[id_col]).alias("ord"), docs[text_col].cast("string").alias("text"))
    kinds = "ord long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
    out = rows.mapInArrow(tidy(_pack(vocabulary, capacity, end_id, with_ids, remembered), "packing"), kinds)
    return out.select(id_of("ord").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")
