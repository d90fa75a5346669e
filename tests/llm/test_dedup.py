import hashlib
import random

import numpy as np
import pytest

from curastra.llm.common import components
from curastra.llm.embedding_neardup import collision, near_vectors, plan
from curastra.llm.ngram_join import similar_groups
from curastra.llm.suffix_dedup import dedup_passages


def brute_passages(rows, length):
    """(id, text) -> what is left, place by place."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        i = -(2**63) if i is None else i
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            first[s] = min(first.get(s, (i, p)), (i, p))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        own = -(2**63) if i is None else i
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < (own, p):
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def _texts(seed):
    r = random.Random(seed)
    words = ["alpha", "beta", "gamma", "délta", "日本語", "x", "longerword"]
    shared = [" ".join(r.choice(words) for _ in range(40)) for _ in range(4)]
    rows = []
    for i in range(40):
        parts = [" ".join(r.choice(words) for _ in range(r.randint(0, 30))) for _ in range(3)]
        parts.insert(r.randint(0, 3), r.choice(shared)[r.randint(0, 20) :])
        rows.append((i, " ".join(parts)))
    rows += [(100, "a" * 700), (101, "b" + "a" * 350), (102, "ab" * 300), (103, ""), (104, None), (105, rows[3][1]), (106, rows[3][1] + rows[5][1])]
    rows += [(7, rows[9][1]), (7, rows[9][1]), (None, rows[11][1]), (None, shared[0])]  # repeated and null ids
    return rows


@pytest.mark.parametrize("seed,crowded", [(1, 4096), (2, 2)])
def test_passages_against_brute_force(frame, seed, crowded):
    rows = _texts(seed)
    got = dedup_passages(frame(rows), 100, crowded=crowded).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=repr) == brute_passages(rows, 100)


def test_passages_over_block_borders(frame, monkeypatch):
    import curastra.llm.suffix_dedup as m

    r = random.Random(4)
    long = "".join(r.choice("abcdefgh ") for _ in range(1_200_000))
    rows = [(1, long), (2, "z" * 50 + long[999_900:1_000_300] + "y" * 200)]
    got = {x.doc_id: (x.n_removed, x.n_spans) for x in dedup_passages(frame(rows), 100, keep_text=False).collect()}
    assert m.BLOCK < len(long) and got[2][0] >= 400 + 100 and got[2][1] == 2


def test_passages_keep_other_columns(frame):
    df = frame([(1, "a", "x"), (2, None, None)], "doc_id long, text string, kept string").withColumn("ord", df_lit("o"))
    out = dedup_passages(df).collect()
    assert sorted((r.doc_id, r.ord, r.kept) for r in out) == [(1, "o", "a"), (2, "o", "")]
    assert dedup_passages(df.limit(0)).count() == 0


def df_lit(v):
    from pyspark.sql import functions as F

    return F.lit(v)


def brute_groups(rows, words, percent):
    def cut(t):
        w = [x for x in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
        return {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())

    sets = [cut(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    key = [-(2**63) if i is None else i for i, _ in rows]
    least = {}
    for k in range(len(rows)):
        least[root(k)] = min(least.get(root(k), key[k]), key[k])
    return sorted(((rows[k][0], len(sets[k]), None if least[root(k)] == -(2**63) else least[root(k)]) for k in range(len(rows))), key=repr)


@pytest.mark.parametrize("seed,words,percent", [(1, 4, 85), (2, 5, 80)])
def test_groups_against_brute_force(frame, seed, words, percent):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(20, 90))] for _ in range(12)]
    rows = []
    for i in range(120):
        w = list(r.choice(base))
        for _ in range(r.randint(0, 5)):  # near copies of all degrees
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((i, " ".join(w).replace("w1", "W1")))
    rows += [(200, None), (201, ""), (202, " \n\t "), (203, "one two"), (204, "ONE\ttwo"), (205, "one two three"), (206, rows[0][1]), (206, rows[0][1]), (207, "\u00a0x \u2003y z a b"), (None, rows[1][1]), (None, "quite alone here now")]
    rows += [(300 + k, " ".join(vocabulary[:60]) + f" tail{k}") for k in range(60)]  # a large group
    got = similar_groups(frame(rows), words, percent).collect()
    assert sorted(((x.doc_id, x.n_shingles, x.component_id) for x in got), key=repr) == brute_groups(rows, words, percent)


def test_groups_of_nothing(frame):
    assert similar_groups(frame([])).count() == 0
    assert [tuple(r) for r in similar_groups(frame([(1, None)])).collect()] == [(1, 0, 1)]


def test_star_of_copies_is_one_group(frame):
    """Copies that only link through their original."""
    words = [f"v{k}" for k in range(200)]
    rows = [(0, " ".join(words))]
    for k in range(1, 40):
        w = list(words)
        for j in range(3):
            w[(k * 5 + j * 47) % 200] = f"n{k}x{j}"
        rows.append((k, " ".join(w)))
    got = similar_groups(frame(rows), 4, 85).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == sorted(brute_groups(rows, 4, 85))
    assert {x.component_id for x in got} == {0}


@pytest.mark.parametrize("hot", [4, 16])
def test_long_lists_are_dealt_out(frame, monkeypatch, hot):
    """Two large groups, one of them half linked, and strangers that share common words."""
    monkeypatch.setattr("curastra.llm.ngram_join.HOT", hot)
    r = random.Random(hot)
    one, two = ([f"{c}{k}" for k in range(80)] for c in "ab")
    rows = [(k, " ".join([*one, f"tail{k}"])) for k in range(90)]
    for k in range(100, 160):
        w = list(two)
        for j in r.sample(range(80), r.randint(0, 9)):
            w[j] = f"n{k}x{j}"
        rows.append((k, " ".join(w)))
    rows += [(200 + k, " ".join(one[:30] + [f"s{k}x{j}" for j in range(r.randint(0, 9))])) for k in range(40)]
    got = similar_groups(frame(rows), 4, 85).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == sorted(brute_groups(rows, 4, 85))


@pytest.mark.parametrize("seed", range(6))
def test_blocks_skip_no_pair_that_may_link(seed):
    from curastra.llm.ngram_join import _block_pairs, _need

    r = np.random.default_rng(seed)
    size = int(r.integers(1, 1500))
    token = np.sort(r.integers(0, 1 + seed, size))
    n = r.integers(10, 40 + 60 * seed, size)
    pos = r.integers(0, 1 + n * 15 // 100)
    comp = np.where(r.random(size) < seed / 6, 7, r.integers(10, 14 + 10 * seed, size))
    order = np.lexsort((comp, pos, n, token))
    token, n, pos, comp = (x[order] for x in (token, n, pos, comp))
    left = n - pos - 1
    met = set()
    for i, j in _block_pairs(token, n, left, comp, 85):
        assert (i < j).all() and (token[i] == token[j]).all()
        new = set(zip(i.tolist(), j.tolist(), strict=True))
        assert not met & new and len(new) == len(i)
        met |= new
    for i in range(size):
        j = np.arange(i + 1, size)
        able = (token[j] == token[i]) & (comp[j] != comp[i]) & (100 * n[i] >= 85 * n[j]) & (1 + np.minimum(left[i], left[j]) >= _need(n[i], n[j], 85))
        assert all((i, int(k)) in met for k in j[able])


def test_a_list_of_one_component_has_no_pair():
    from curastra.llm.ngram_join import _block_pairs

    for size in (1, 64, 65, 4_000, 64_000):
        token, n = np.zeros(size, dtype=np.int64), np.sort(np.arange(size) % 50 + 400)
        assert sum(len(i) for i, _ in _block_pairs(token, n, n - 1, token, 85)) == 0
        # one stranger in it meets the others, who don't meet each other but in its block
        comp = token.copy()
        comp[size // 2] = 1
        assert sum(len(i) for i, _ in _block_pairs(token, n, n - 1, comp, 85)) <= size + 64 * 64


@pytest.mark.parametrize("few", [0, 20, 100_000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr("curastra.llm.common.FEW", few)
    r = random.Random(8)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    groups, want = {}, {}
    for x in components(spark.createDataFrame(edges, "a long, b long")).collect():
        groups.setdefault(x.component, set()).add(x.node)
    for n in parent:
        want.setdefault(root(n), set()).add(n)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_vectors_against_all_pairs(spark):
    r = np.random.default_rng(3)
    base = r.standard_normal((40, 16))
    v = np.concatenate([base, base[:20] + 0.05 * r.standard_normal((20, 16)), base[:10] * 3, np.repeat(base[:1] + 0.01, 30, axis=0), base[:1] + 0.02 * r.standard_normal((50, 16))])
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    odd = [(900, None), (901, []), (902, [0.0] * 16), (903, [float("nan")] * 16), (904, [1.0, None]), (905, [float("inf")] + [1.0] * 15), (906, [2.0, 1.0]), (907, [4.0, 2.0]), (0, v[0].tolist())]
    got = {}
    for x in near_vectors(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")).collect():
        got.setdefault(x.vec_id, []).append((x.n_links, x.component_id, x.kept))
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(v))
    for _ in range(len(v)):
        label = np.minimum(label, np.where(near, label[None], 10**9).min(axis=1))
    again = near[0].copy()
    again[0] = True
    n = near.sum(axis=1) + again
    found = sum(got[i][0][0] for i in range(len(v)))
    assert found >= 0.99 * n.sum() and all(got[i][0][0] <= n[i] for i in range(len(v)))
    assert [got[i][0][1] for i in range(len(v))] == label.tolist()
    assert all(got[k] == [(0, k, True)] for k in (900, 901, 902, 903, 904, 905)) and got[906] == [(1, 906, True)] and got[907] == [(1, 906, False)]
    assert len(got[0]) == 2
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_null_vector_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.001]), (6, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in near_vectors(df).collect()}
    assert got == {None: (1, None, True), 5: (1, None, False), 6: (0, 6, True)}


def test_plan_follows_the_number_of_vectors():
    small, large = plan(1000, 0.95), plan(10**9, 0.95)
    assert small[0] < large[0] and small[1] < large[1]
    near = collision((2 - 2 * 0.95) ** 0.5)
    for k, tables in (small, large):
        assert 1 - (1 - near**k) ** tables >= 0.998
