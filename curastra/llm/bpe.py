"""Byte-level BPE: encoding by merge ranks, decoding by vocabulary strings.

The merge loop keeps the symbols of a pre-token in a doubly linked list and the possible
merges in a priority queue by (rank, place). A popped merge is stale if its left symbol has
gone or has another partner by now; stale entries are skipped. Pre-tokens repeat a lot, so
each worker remembers the ids of those it has merged, up to a fixed number.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Pre-tokens that a worker remembers; then it forgets all and starts anew.
REMEMBERED = 400_000
#: Longer pre-tokens (in bytes) are not remembered.
LONG = 256
#: How byte-level vocabularies cut a text before merging.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a vocabulary's strings.

    Bytes that are printable in Latin-1 stand for themselves; the others follow from 256 on.
    """
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        byte_of = {c: b for b, c in letters.items()}
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.first = [vocab[letters[b]] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.strings = [b""] * size
        for s, i in vocab.items():
            self.strings[i] = bytes(byte_of[c] for c in s)
        for s, i in self.special.items():
            self.strings[i] = s.encode()
        #: (left id, right id) -> (rank, merged id)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.cut = regex.compile(PRETOKEN)
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        sym = [self.first[b] for b in piece]
        n = len(sym)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        merges, queue = self.merges, []
        for i in range(n - 1):
            if m := merges.get((sym[i], sym[i + 1])):
                queue.append((m[0], i, m[1]))
        heapq.heapify(queue)
        while queue:
            rank, i, new = heapq.heappop(queue)
            j = after[i]
            if sym[i] < 0 or j < 0 or merges.get((sym[i], sym[j])) != (rank, new):
                continue  # stale
            sym[i], sym[j] = new, -1
            k = after[j]
            after[i] = k
            if k >= 0:
                before[k] = i
                if m := merges.get((new, sym[k])):
                    heapq.heappush(queue, (m[0], i, m[1]))
            h = before[i]
            if h >= 0 and (m := merges.get((sym[h], new))):
                heapq.heappush(queue, (m[0], h, m[1]))
        return [s for s in sym if s >= 0]

    def packed(self, piece: str) -> bytes:
        """Ids of one pre-token as little-endian unsigned 32-bit integers."""
        data = piece.encode()
        out = np.array(self.merge(data), dtype="<u4").tobytes()
        if len(data) <= LONG:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = out
        return out

    def _ordinary(self, text: str) -> bytes:
        known, out = self.known, []
        for piece in self.cut.findall(text):
            ids = known.get(piece)
            out.append(self.packed(piece) if ids is None else ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids of a text, packed; strings of special tokens become their ids."""
        if self.special_cut is None or not any(s in text for s in self.special):
            return self._ordinary(text)
        parts = self.special_cut.split(text)
        return b"".join(self.special[p].to_bytes(4, "little") if k % 2 else self._ordinary(p) for k, p in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that aren't UTF-8 become replacement characters."""
        strings = self.strings
        return b"".join([strings[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", "replace")


def _worker(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(path)
        names = ["rest", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
        for batch in batches:
            count, digest, decoded, ids_out, text_out = [], [], [], [], []
            for value in batch.column("text"):
                ids = bpe.encode(value.as_py() or "")
                text = bpe.decode(ids)
                count.append(len(ids) // 4)
                digest.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(text.encode("utf-8", "replace")).hexdigest())
                ids_out.append(np.frombuffer(ids, dtype="<u4").astype(np.int32) if with_ids else None)
                text_out.append(text if with_ids else None)
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(count, pa.int64()), pa.array(digest, pa.string()), pa.array(decoded, pa.string()), pa.array(ids_out, pa.list_(pa.int32())), pa.array(text_out, pa.string())], names=names)

    return run


def encode_decode(docs: DataFrame, vocabulary: str, text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode its ids again.

    ``vocabulary`` is the path of a byte-level BPE file that every executor can read. Adds
    ``n_tokens``, ``ids_sha256`` (of little-endian unsigned 32-bit ids), ``decoded_sha256``
    and, with ``with_ids``, ``ids`` and ``decoded`` (else null); input columns with those
    names are replaced. A null text is encoded as empty: no ids. One row for each input row,
    repeated ones too; no shuffle.
    """
    from pyspark.sql import functions as F

    new = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
    others = [c for c in docs.columns if c not in new]
    rows = docs.select(F.struct(*(docs[c] for c in others if c != text_col), F.lit(0).alias("_")).alias("rest"), docs[text_col].cast("string").alias("text"))
    kind = rows.schema["rest"].dataType.simpleString()
    out = rows.mapInArrow(_worker(vocabulary, with_ids), f"rest {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<int>, decoded string")
    return out.select(*(F.col("rest")[c].alias(c) for c in others if c != text_col), *new)
