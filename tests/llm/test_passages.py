"""Passages at hot triggers, over batch borders, in rows that share ids, in long texts."""

import random

import numpy as np
import pyarrow as pa
import pytest

import curastra.llm.suffix_dedup as m
from curastra.llm.suffix_dedup import dedup_passages
from tests.llm.test_dedup import brute_passages


def _rows(got):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()), key=repr)


@pytest.fixture
def passages():
    """One passage in many contexts, copies, and rows that share ids or have none."""
    r = random.Random(11)
    letter = lambda n: "".join(r.choice("abcdefghij ") for _ in range(n))
    shared = letter(260)
    rows = [(i, letter(r.randint(0, 150)) + shared[r.randint(0, 40) :] + letter(r.randint(0, 150))) for i in range(150)]
    rows += [(None, letter(130) + rows[k][1]) for k in range(40)] + [(None, rows[3][1])] * 5
    return rows + [(7, letter(220)), (7, letter(40) + shared), (200, None), (201, ""), (202, "é" * 120)]


@pytest.mark.parametrize("least", [1, 64])
def test_hot_triggers_are_dealt_out_with_the_same_result(frame, monkeypatch, passages, least):
    monkeypatch.setattr(m, "HOT_LEAST", least)
    monkeypatch.setattr(m, "HOT_SHARE", 1e-9)
    df = frame(passages)
    assert (len(m._hot_buckets(m._keyed(df, "doc_id", "text"), 100)) > 50) == (least == 1)
    assert _rows(dedup_passages(df, 100)) == brute_passages(passages, 100)


def test_rows_that_share_an_id_are_told_apart(frame):
    """Very many rows without an id, each with a text of its own."""
    r = random.Random(5)
    base = ["".join(r.choice("abcdefgh") for _ in range(140)) for _ in range(40)]
    rows = [(None, f"{k} " + base[k % 40]) for k in range(3000)]
    assert _rows(dedup_passages(frame(rows), 100)) == brute_passages(rows, 100)


@pytest.mark.parametrize("size", [1, 2, 3, 1000])
def test_resolving_does_not_depend_on_batches(size):
    r = np.random.default_rng(size)
    n = 400
    g, e, o, lo = r.integers(0, 25, n), r.integers(0, 4, n), r.integers(0, 6, n), r.integers(0, 3, n)
    kind = np.where(g == 3, m._HOT, np.where(r.random(n) < 0.1, m._REPEAT, m._SEEK))
    meta = m._pack(lo, 0, kind)
    by = np.lexsort((o, meta, o, e, g))
    cols = [x[by].astype(np.int64) for x in (g, e, o, o, meta)]
    batches = [m._batch(m._PARSE_FIELDS, *(x[i : i + size] for x in cols)) for i in range(0, n, size)]
    table = pa.Table.from_batches(list(m._resolve(iter(batches)))).to_pylist()
    got = sorted((x["g"] if m._kind(x["meta"]) != m._REPEAT else 0, x["ord"], m._lo(x["meta"]), m._kind(x["meta"]), x["k"]) for x in table)
    first, phrases = {}, {}
    for a, b, c, d in zip(*(x.tolist() for x in cols[:3]), cols[4].tolist(), strict=True):
        if m._kind(d) != m._REPEAT:
            first.setdefault((a, b), (c, m._lo(d)))
            if b not in phrases.setdefault(a, []):
                phrases[a].append(b)  # rows at one place have one tag here
    want = []
    for a, b, c, d in zip(*(x.tolist() for x in cols[:3]), cols[4].tolist(), strict=True):
        if m._kind(d) == m._REPEAT or (c, m._lo(d)) != first[a, b]:
            want.append((0, c, m._lo(d), m._REPEAT, 0))
    for a, own in phrases.items():
        if len(own) > 1 or a == 3:
            want += [(a, *first[a, b], m._CROWD if a == 3 else m._PHRASE, k) for k, b in enumerate(own)]
    assert got == sorted(want)


def test_repeated_identical_rows_and_clashing_columns(frame):
    text = "the same long passage is here " * 8
    df = frame([(1, text, "x", "y"), (1, text, "x", "y"), (2, text, None, None)], "doc_id long, text string, runs string, tag string").withColumnRenamed("runs", "wants")
    got = sorted((r.doc_id, r.n_removed, r.wants, r.tag) for r in dedup_passages(df).collect())
    assert [x[0] for x in got] == [1, 1, 2] and got[2][1] == len(text) and got[0][1:] == got[1][1:] and got[0][2:] == ("x", "y")


def test_a_text_of_many_blocks(frame):
    r = random.Random(4)
    long = "".join(r.choice("abcdefgh ") for _ in range(2_300_000))
    rows = [(1, long), (2, "z" * 50 + long[999_900:1_000_300] + "y" * 30 + long[1_999_950:2_000_150])]
    got = {x.doc_id: (x.n_removed, x.n_spans) for x in dedup_passages(frame(rows), 100, keep_text=False).collect()}
    assert got == {1: (0, 0), 2: (600, 2)}
