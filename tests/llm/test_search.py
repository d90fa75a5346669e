"""Ranked search against brute force; order of documents, bounds, stopping, ties, odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from curastra.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain(docs, items, k):
    held = [(i, Counter(t)) for i, text in docs if (t := terms(text))]
    total, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 50 + (50 * sum(c.values()) * total) // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def _corpus(n, seed):
    r = random.Random(seed)
    common = [f"w{k}" for k in range(30)]
    topics = [[f"t{t}x{k}É" for k in range(40)] for t in range(6)]
    word = lambda topic: r.choice(common) if r.random() < 0.4 else r.choice(topic).upper() if r.random() < 0.3 else r.choice(topic)
    return [(i, r.choice([" ", ", ", "\n", "_"]).join(word(topics[i % 6]) for _ in range(r.choice([1, 3, 8, 30, 90])))) for i in range(n)], topics, common, r


@pytest.mark.parametrize("k", [3, 50])
def test_against_brute_force(spark, frame, monkeypatch, k):
    monkeypatch.setattr(ls, "SHARD", 60)
    monkeypatch.setattr(ls, "CLUSTER", 8)
    monkeypatch.setattr(ls, "VISITS", (2, 3, None))
    docs, topics, common, r = _corpus(700, k)
    docs += [(10_000 + i, docs[5][1]) for i in range(230)]  # a large group of copies: ties by id
    docs += [(None, docs[9][1]), (None, None), (3, docs[4][1]), (7001, ""), (7002, " ,;\n\t~"), (7003, "日本語 ２ ½")]
    items = [(i, " ".join(r.choice(topics[i % 6] + common) for _ in range(r.choice([1, 2, 9, 40])))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "no such words"), (103, docs[5][1]), (104, "日本語"), (None, docs[8][1])]
    got = ls.rank(frame(docs).repartition(5), spark.createDataFrame(items, "item_id long, text string"), k)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, items, k)


def test_groups_of_items_long_texts_few_rows_and_clashing_columns(spark, frame, monkeypatch):
    monkeypatch.setattr(ls, "TOGETHER", 5)
    monkeypatch.setattr(ls, "BLOCK", 100)
    docs, topics, _, _ = _corpus(60, 4)
    docs.append((77, " ".join(topics[0]) * 300))
    items = [(i, docs[i][1]) for i in range(9)]
    clash = spark.createDataFrame([(*d, 1, "t", 2.0, b"x") for d in docs], "doc_id long, text string, ord int, term string, score double, qid binary")
    got = ls.rank(clash, spark.createDataFrame([(*x, 1, 2) for x in items], "item_id long, text string, rank int, doc_id int"), 10)
    assert sorted(map(tuple, got.collect()), key=repr) == plain(docs, items, 10)
    some = spark.createDataFrame(items, "item_id long, text string")
    assert ls.rank(frame([]), some).collect() == []
    assert ls.rank(frame(docs), some.limit(0)).collect() == []
    assert ls.rank(frame([(1, None), (2, "...")]), some).collect() == []


def test_bisection_puts_alike_documents_together():
    r = random.Random(2)
    kind = [r.randrange(8) for _ in range(512)]
    sets = [sorted({k * 50 + r.randrange(50) for _ in range(20)} | {400 + r.randrange(30) for _ in range(5)}) for k in kind]
    doc, term = np.repeat(np.arange(512), [len(s) for s in sets]), np.concatenate(sets)
    for node, weight, bias in ls.bisected(doc, term, 512, 430, 3):
        assert np.bincount(node).max() - np.bincount(node).min() <= 1
    same = sum(Counter(k for k, n in zip(kind, node, strict=True) if n == leaf).most_common(1)[0][1] for leaf in range(8))
    assert same > 0.6 * 512  # 1 in 8 in a leaf without any order
    assert weight.shape == (4, 430) and bias.shape == (4,)


def test_visits_stop_before_all_clusters():
    rows = [[i, 4, b"rare common" if i < 100 else b"common", np.array([9, 1] if i < 100 else [1], dtype="<u4").tobytes()] for i in range(2000)]
    batch = ls._indexed(0, rows, 2000, 8000)
    cols = {c: batch.column(c).to_pylist() for c in batch.schema.names}
    shard = ls.Shard(cols["pos"][0])
    names = {t: i for i, t in enumerate(cols["term"])}
    for t, i in names.items():
        if t:
            shard.terms[i] = tuple(cols[c][i] for c in ("pos", "q", "cl", "mx"))
    plan = [(names[b"rare"], 5000), (names[b"common"], 10)]
    scores, ords = shard.best(plan, 50, 1)
    assert ords.tolist() == list(range(50)) and len(set(scores.tolist())) == 1
    bound = shard.bounds(plan)
    assert (bound >= scores[-1]).sum() < shard.clusters / 2  # the others need no visit
