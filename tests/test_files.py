"""Digests of files, whole, by ranges and as trees, against hashlib."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from curastra.operators import freeze, records


def _sha(data):
    return hashlib.sha256(data).hexdigest()


def _root(digests, fanout):
    while len(digests) > 1:
        digests = [_sha("\n".join(digests[i : i + fanout]).encode()) for i in range(0, len(digests), fanout)]
    return digests[0]


@pytest.fixture()
def folder(tmp_path):
    at = tmp_path / "a b%20c"  # a path that a URI has to escape
    at.mkdir()
    sizes = {"empty": 0, "one": 1000, "exact": 3000, "long": freeze.PIECE * 2 + 17, "deep": 28_500}
    data = {k: os.urandom(n) for k, n in sizes.items()}
    for k, v in data.items():
        (at / k).write_bytes(v)
    return at, data


def _by_name(rows):
    return {r.path.rsplit("/", 1)[1]: r for r in rows}


def test_whole_files_are_streamed(spark, folder):
    at, data = folder
    got = _by_name(freeze.file_digests(spark, [str(at)]).collect())
    assert {k: r.sha256 for k, r in got.items()} == {k: _sha(v) for k, v in data.items()}


def test_trees_of_ranges(spark, folder):
    at, data = folder
    chunks = freeze.chunk_digests(spark, [str(at)], 1000)
    want = {k: [v[i : i + 1000] for i in range(0, len(v), 1000)] or [b""] for k, v in data.items()}
    got = {(r.path.rsplit("/", 1)[1], r.chunk): (r.offset, r.length, r.sha256) for r in chunks.collect()}
    assert got == {(k, i): (i * 1000, len(c), _sha(c)) for k, v in want.items() for i, c in enumerate(v)}
    roots = _by_name(freeze.tree_digests(chunks, 3).collect())
    assert {k: (r.n_chunks, r.root) for k, r in roots.items()} == {k: (len(v), _root([_sha(c) for c in v], 3)) for k, v in want.items()}
    assert freeze.tree_digests(chunks.limit(0)).count() == 0
    for broken in (chunks.where("chunk <> 1"), chunks.unionByName(chunks.where("chunk = 0"))):
        with pytest.raises(Exception, match="aren't whole"):
            freeze.tree_digests(broken).collect()


def test_a_changed_chunk_is_named(spark, folder):
    at, data = folder
    before = spark.createDataFrame(freeze.chunk_digests(spark, [str(at)], 1000).collect())
    deep = bytearray(data["deep"])
    deep[12_345] ^= 1
    (at / "deep").write_bytes(deep)
    (at / "one").write_bytes(data["one"] + b"x")
    (at / "exact").write_bytes(data["exact"][:2000])
    found = freeze.changed_chunks(before, freeze.chunk_digests(spark, [str(at)], 1000)).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.chunk, r.what) for r in found) == [("deep", 12, "changed"), ("exact", 2, "missing"), ("one", 1, "added")]
    frozen = freeze.tree_digests(before).select("path", F.col("root").alias("sha256"))
    now = freeze.tree_digests(freeze.chunk_digests(spark, [str(at)], 1000)).select("path", F.col("root").alias("sha256"))
    with pytest.raises(ValueError, match="deep, .*exact, .*one"):
        freeze.verify(frozen, now)


def test_a_file_that_shrinks_fails(spark, folder):
    at, _ = folder

    def short(path):
        import io

        return io.BytesIO(b"x")

    with pytest.raises(Exception, match="bytes early"):
        freeze.chunk_digests(spark, [str(at / "one")], 1000, short).collect()


def test_chunks_of_texts(spark):
    rows = spark.createDataFrame([(1, "é" * 300), (2, None), (3, ""), (4, "x" * 256)], "doc_id int, text string")
    got = {(r.path, r.chunk): r.sha256 for r in freeze.text_chunks(rows, "doc_id", "text", 256).collect()}
    data = ("é" * 300).encode()
    want = {("1", i): _sha(data[256 * i : 256 * i + 256]) for i in range(3)}
    assert got == want | {("2", 0): _sha(b""), ("3", 0): _sha(b""), ("4", 0): _sha(b"x" * 256)}


def test_prompts_carry_the_facts(spark):
    row = spark.createDataFrame([("src/a.ts", "play", "G1", "play(): void", ["Card"], "play() {}", "Write play.", ("G1", 3))], "source_path string, symbol string, granularity string, signature string, provided_symbols array<string>, target string, instruction string, scope struct<level string, n int>")
    asked, judged = row.select(records.generation_prompt(), records.review_prompt()).first()
    assert asked.splitlines()[1:] == ["Target file: src/a.ts", "Target symbol: play", "Granularity: G1", "Signature: play(): void", 'Potential provided symbols: ["Card"]', "Target:", "```typescript", "play() {}", "```"]
    assert judged.splitlines()[1:] == ['Scope: {"level":"G1","n":3}', "Signature: play(): void", "Instruction: Write play.", "Target:", "```typescript", "play() {}", "```"]
