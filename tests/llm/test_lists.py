"""Index lists of the shingle join: the complete walk gives a pair once, not once for each list that holds both."""

import numpy as np
import pyarrow as pa

from curastra.llm import ngram_join


def _walked(lists: dict[int, dict[int, int]]) -> list[tuple[int, int]]:
    """Pairs from lists (name: position by set), each read by a task of its own."""
    own = {}
    for name, sets in lists.items():
        for node, pos in sets.items():
            own.setdefault(node, []).append((pos, name))
    first = {node: np.array(([x for _, x in sorted(at)] + [0] * ngram_join.FIRST)[: ngram_join.FIRST]).tobytes() for node, at in own.items()}
    found = []
    for name, sets in lists.items():
        rows = [{"token": name, "list": name, "n": 200, "node": node, "pos": pos, "comp": node, "deg": 0, "mini": bytes(64), "first": first[node]} for node, pos in sorted(sets.items(), key=lambda x: x[1])]
        for batch in ngram_join._walk("all", 85)(iter([pa.RecordBatch.from_pylist(rows)])):
            found += zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)
    return found


def test_a_pair_is_given_by_its_first_list():
    # sets 1 to 6 share twelve lists; -3 and 2, the last of which stands in the ninth and later lists only, share few
    lists = {100 + k: {node: k for node in range(1, 7)} for k in range(12)}
    lists[110][-3] = lists[111][-3] = 1
    found = _walked(lists)
    inner = [(a, b) for a in range(1, 7) for b in range(a + 1, 7)]
    assert sorted(x for x in found if -3 not in x) == inner
    assert set(x for x in found if -3 in x) == {(-3, b) for b in range(1, 7)}  # beyond the first lists: given, maybe twice


def test_names_of_first_lists():
    node = np.repeat(np.array([-5, 7, 9]), [3, 12, 1])
    token = np.arange(1, 17)
    batch = pa.RecordBatch.from_arrays([pa.array(node), pa.array(token)], names=["node", "token"])
    got = {r["node"]: np.frombuffer(r["first"], dtype=np.int64).tolist() for b in ngram_join._first_lists(iter([batch])) for r in b.to_pylist()}
    assert got == {-5: [1, 2, 3, 0, 0, 0, 0, 0], 7: list(range(4, 12)), 9: [16, 0, 0, 0, 0, 0, 0, 0]}


def test_two_components_have_one_likeliest_pair_of_a_list():
    near, far = bytes(64), bytes([255] + [0] * 63)
    first = np.zeros(ngram_join.FIRST, dtype=np.int64).tobytes()
    rows = [{"token": 1, "list": 1, "n": 200, "node": k, "pos": k // 50, "comp": k % 2, "deg": 0, "mini": near if k in (30, 71) else far if k % 2 else bytes([0] * 63 + [255]), "first": first} for k in range(100)]
    found = {}
    for mode in ("best", "all"):
        found[mode] = [(a, b) for x in ngram_join._walk(mode, 80)(iter([pa.RecordBatch.from_pylist(rows)])) for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist(), strict=True)]
    assert len(found["all"]) == 50 * 50  # was listed before what the likeliest pairs link was known
    assert (30, 71) in found["best"] and set(found["best"]) <= set(found["all"])
    assert len(found["best"]) <= 2 * ngram_join.ENTRIES  # one for each step of the walk
