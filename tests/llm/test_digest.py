"""Fingerprints against a plain version; likeness over lengths; long texts; clashing columns."""

import random

import numpy as np
import pytest

from curastra.llm import fingerprint as fp


def _packed(texts):
    data = [t.encode() for t in texts]
    size = np.array([len(d) for d in data], dtype=np.int64)
    return np.frombuffer(b"".join(data), dtype=np.uint8), np.cumsum(size) - size, size


def _texts():
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(r.randint(1, 9))) for _ in range(300)]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    return [make(n) for n in (0, 1, 3, 5, 6, 7, 9, 12, 20, 40, 90, 200, 2, 30)] + ["a" * 31, "a" * 32, "ab" * 200, "a" * 33 + make(4), ""]


def plain_features(text, rank):
    data = text.encode()
    w = len(data) - fp.WINDOW + 1
    if 0 < len(data) < fp.WINDOW:
        return [data.ljust(fp.WINDOW, b"\0")]
    step = fp.entropy_steps(np.frombuffer(data, dtype=np.uint8))
    votes = [0] * max(w, 0)
    for s in range(1 - fp.NEIGHBOURS, w):
        votes[min(range(max(s, 0), min(s + fp.NEIGHBOURS, w)), key=lambda p: (rank[step[p]], p))] += 1
    return list(dict.fromkeys(data[p : p + fp.WINDOW] for p in range(w) if votes[p] >= fp.POPULAR))


def plain_filters(features):
    out = []
    for i, f in enumerate(features):
        if i % fp.FEATURES == 0:
            out.append(set())
        h = int(fp._hash(np.frombuffer(f, dtype=np.uint8)[None])[0])
        out[-1] |= {(h >> 11 * k) % fp.BITS for k in range(fp.PROBES)}
    return out


def plain_likeness(x, y):
    if x == y:
        return 1.0
    if not x or not y:
        return 0.0
    x, y = sorted((x, y), key=len)
    best = []
    for a in x:
        room = lambda b, a=a: (min(len(a), len(b)) - len(a) * len(b) / fp.BITS, len(a & b) - len(a) * len(b) / fp.BITS)
        best.append(max(max(0.0, min(1.0, s / m)) if m > 0 else 0.0 for m, s in map(room, y)))
    return sum(best) / len(best)


@pytest.mark.parametrize("block", [80, 500_000])
def test_features_and_likeness_against_a_plain_version(monkeypatch, block):
    monkeypatch.setattr(fp, "BLOCK", block)
    monkeypatch.setattr(fp, "FEATURES", 10)  # so that chains are long
    texts = _texts()
    rank = np.random.default_rng(1).permutation(fp.STEPS + 1)
    got = fp.features(*_packed(texts), rank)
    want = [plain_features(t, rank) for t in texts]
    assert [[int(h) for h in g] for g in got] == [[int(fp._hash(np.frombuffer(f, dtype=np.uint8)[None])[0]) for f in w] for w in want]
    assert all(len(g) for g, t in zip(got, texts, strict=True) if t)
    chains, plain = [fp.chain(g) for g in got], [plain_filters(w) for w in want]
    assert [[set(np.flatnonzero(np.unpackbits(row)).tolist()) for row in c] for c in chains] == plain
    for i in range(len(texts)):
        for j in range(i, len(texts)):
            assert fp.likeness(chains[i], chains[j]) == pytest.approx(plain_likeness(plain[i], plain[j]), abs=1e-9)


def test_histogram_counts_every_window_once(frame, monkeypatch):
    texts = _texts()
    want = np.zeros(fp.STEPS + 1, dtype=np.int64)
    for t in texts:
        np.add.at(want, fp.entropy_steps(np.frombuffer(t.encode(), dtype=np.uint8)), 1)
    rank = fp.rarity(frame(list(enumerate(texts))))
    assert sorted(range(fp.STEPS + 1), key=lambda s: (want[s], s)) == sorted(range(fp.STEPS + 1), key=rank.__getitem__)


def test_a_text_and_its_extension_stay_alike_over_all_lengths():
    """One kind of feature for all lengths: what is kept counts, whatever the lengths are."""
    r = random.Random(9)
    rank = np.random.default_rng(3).permutation(fp.STEPS + 1)
    mean = []
    for n in range(60, 301, 20):
        texts = ["".join(r.choice("abcdefghijklmnop qrstuvwxyz") for _ in range(n)) for _ in range(40)]
        longer = [t + "".join(r.choice("abcdefghijklmnop qrstuvwxyz") for _ in range(80)) for t in texts]
        a, b = fp.features(*_packed(texts), rank), fp.features(*_packed(longer), rank)
        mean.append(np.mean([fp.likeness(fp.chain(x), fp.chain(y)) for x, y in zip(a, b, strict=True)]))
    assert min(mean) > 0.4 and all(later > before - 0.12 for before, later in zip(mean, mean[1:], strict=False)) and mean[-1] > mean[0]


def test_long_texts_and_clashing_columns(frame):
    r = random.Random(1)
    long = "".join(r.choice("abcdefghij klmno") for _ in range(1_300_000))
    df = frame([(1, long, "x"), (2, long, "x"), (3, None, None)], "doc_id long, text string, rest string")
    got = {x.doc_id: x for x in fp.fingerprint(df).collect()}
    assert got[1].fingerprint == got[2].fingerprint and got[1].rest == "x" and got[3].fingerprint == ""
    one = {x.doc_id: (x.near_edited, x.near_next) for x in fp.compare_with_next(df).collect()}
    assert one[1][1] == 1.0 and 0.4 < one[2][0] <= 1 and one[2][1] == 0.0
