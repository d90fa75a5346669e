"""Line dedup against a plain version: batches, ties, repeated rows, nulls, long texts, clashing columns."""

import hashlib
import random
from collections import defaultdict

import pytest

from curastra.llm.line_dedup import dedup_lines

KEPT = ["doc_id", "n_lines", "n_dropped", "kept_sha256", "kept"]


def plain(rows, min_chars=20, min_docs=3):
    order = lambda i: (i is not None, i or 0)
    holders = defaultdict(list)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for i, text in rows:
        for k in {key(x) for x in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(h := holders.get(key(x), [])) >= min_docs and order(i) < max(map(order, h)))]
        text = "\n".join(kept)
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256(text.encode()).hexdigest(), text))
    return sorted(out, key=repr)


def _made(seed):
    r = random.Random(seed)
    shared = [r.choice(["  ", "\t", ""]) + "".join(r.choice("abcÄé xyzABC") for _ in range(n)) + r.choice([" ", "\r", "\x0b", ""]) for n in (17, 18, 19, 20, 21, 22, 25, 40, 90, 300)]
    rows = []
    for i in range(60):
        lines = [r.choice(shared) if r.random() < 0.5 else r.choice(["", "short", f"a line of its own {i} {r.random()}"]) for _ in range(r.randrange(9))]
        rows.append((i * 7, "\n".join(x.upper() if r.random() < 0.2 and x.isascii() else x for x in lines)))
    return rows


@pytest.mark.parametrize("batches", [1, 2, 5, 6])
def test_against_a_plain_version(frame, batches):
    rows = _made(batches)
    r = random.Random(1)
    rows += [(None, rows[3][1]), (None, None), (7, rows[1][1]), (7, rows[1][1]), (7, rows[4][1]), (10**15, None), (5, "")]
    r.shuffle(rows)
    got = dedup_lines(frame(rows), batches=batches)
    assert got.columns == KEPT
    assert sorted(map(tuple, got.collect()), key=repr) == plain(rows)


def test_a_line_in_a_third_of_all_rows_and_a_very_long_text(frame):
    rows = [(i, f"the very common line of a third\nown line number {i} of its text" if i % 3 == 0 else f"x{i}") for i in range(900)]
    rows.append((450, "the very common line of a third\n" * 40_000 + "z" * 3_000_000))
    got = {tuple(x) for x in dedup_lines(frame(rows)).collect()}
    assert got == set(plain(rows))
    assert sum(x[2] for x in got) == 299 + 40_000


def test_other_thresholds_few_rows_and_clashing_columns(spark, frame):
    rows = [(1, "same line"), (2, "same line"), (3, " SAME LINE\nother")]
    for m, c in ((2, 1), (3, 9), (4, 1), (3, 10)):
        assert sorted(map(tuple, dedup_lines(frame(rows), min_chars=c, min_docs=m).collect()), key=repr) == plain(rows, c, m)
    assert dedup_lines(frame([])).collect() == []
    clash = spark.createDataFrame([(*x, 1, "n", 2.0, "k", 5) for x in rows], "doc_id long, text string, ord int, th string, n_lines double, kept string, batch int")
    assert sorted(map(tuple, dedup_lines(clash, min_chars=1).collect()), key=repr) == plain(rows, 1)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]
