"""A flaky transport, merged records, tokens against the library, order by locale."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from curastra.functions.merge import merge_columns
from curastra.functions.text import by_locale
from curastra.operators import chat
from curastra.plans import record_queries, requests

SF = "/root/testdata/sf0.001"


def test_retries_pauses_and_refusals():
    calls, pauses = [], []

    def transport(record):
        calls.append(record["id"])
        if record["id"] == 2:
            raise requests.Refused("not allowed")
        if record["id"] == 3 or calls.count(record["id"]) <= record["id"]:
            raise ConnectionError("busy")
        return {"n": record["id"], "é": None}

    import pandas as pd

    run = requests.asking(transport, tries=4, in_flight=1, pause=pauses.append)
    got = next(run(iter([pd.DataFrame({"id": [0, 1, 2, 3]})])))
    assert got["answer"].tolist() == ['{"n": 0, "é": null}', '{"n": 1, "é": null}', None, None]
    assert got["error"].tolist() == [None, None, "not allowed", "request failed after 4 attempts: busy"]
    assert got["tries"].tolist() == [1, 2, 1, 4] and pauses == [1, 1, 2, 4]
    assert [len(x) for x in run(iter([pd.DataFrame({"id": []})]))] == [0]


def test_failed_units_stay_pending(spark):
    def flaky(down):
        def transport(record):
            if record["unit_id"] in down:
                raise TimeoutError("no answer")
            assert record["prompt"].startswith("about ")
            if record["unit_id"] == "u4":
                return {"target_file": "x"}
            return {"target_file": "a.ts", "target_symbol": "f", "expected_behavior": ["b"], "constraints": [], "required_context": [], "instruction": f"  do {record['unit_id']} ", "status": "completed", "response_id": "r"}

        return transport

    units = spark.createDataFrame([(f"u{i}", "t", "old") for i in range(6)], "unit_id string, target string, instruction string")
    done = spark.createDataFrame([("u0",)], "unit_id string")
    prompt = F.concat(F.lit("about "), "target")
    records, failures = requests.generated(units, done, prompt, flaky({"u2", "u3"}), "m", tries=2, pause=lambda s: None)
    assert records.columns == ["unit_id", "target", "instruction", "scope", "generation"]
    got = {r.unit_id: r for r in records.collect()}
    assert sorted(got) == ["u1", "u5"] and got["u1"].instruction == "do u1" and got["u1"].generation.response_completed and got["u5"].scope.target_file == "a.ts"
    assert {r.unit_id: (r.error, r.tries) for r in failures.collect()} == {"u2": ("request failed after 2 attempts: no answer", 2), "u3": ("request failed after 2 attempts: no answer", 2), "u4": ("the answer has no instruction", 1)}
    later, _ = requests.generated(units, done.unionByName(records.select("unit_id")), prompt, flaky(()), "m")
    assert sorted(r.unit_id for r in later.collect()) == ["u2", "u3"]


def test_merge_of_records(spark):
    rows = spark.sql("""SELECT named_struct('k', 1, 'in', named_struct('a', 1, 'b', named_struct('x', 1)), 'l', array(1)) AS one,
      named_struct('in', named_struct('b', named_struct('y', 2), 'c', 3), 'l', array(2), 'new', CAST(NULL AS STRING)) AS two, CAST(NULL AS STRUCT<k: INT, in: STRUCT<a: INT>>) AS three, named_struct('in', CAST(NULL AS STRUCT<a: INT>)) AS four""")
    deep = merge_columns(rows, "one", "two", "three").first().asDict(recursive=True)
    assert deep == {"k": 1, "in": {"a": 1, "b": {"x": 1, "y": 2}, "c": 3}, "l": [2], "new": None}
    flat = merge_columns(rows, "one", "two", deep=False).first().asDict(recursive=True)
    assert flat == {"k": 1, "in": {"b": {"y": 2}, "c": 3}, "l": [2], "new": None}
    assert merge_columns(rows, "one", "four").first()["in"] is None


def test_tokens_against_the_library(spark):
    pytest.importorskip("tokenizers")
    encode = record_queries._byte_bpe()
    talks = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        talks.setdefault(r.conv_id, []).append((r.turn, r.role, r.text))
    told = lambda turns: "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for _, role, text in turns)
    got = {r.conv_id: r for r in record_queries.token_masks(spark, SF).collect()}
    assert set(got) == set(talks)
    for conv, turns in talks.items():
        turns.sort()
        if any(None in t for t in turns):
            continue
        ids, prompt = encode([told(turns), told(turns[:1]) + "<|im_start|>assistant\n"])
        assert got[conv].ids_digest == hashlib.sha256(",".join(map(str, ids[:512])).encode()).hexdigest()
        if ids[: len(prompt)] == prompt and len(prompt) < min(len(ids), 512):
            assert (got[conv].error, got[conv].n_labels) == (None, min(len(ids), 512) - len(prompt))
        else:
            assert got[conv].error
    loads = chat.encoded(spark.createDataFrame([(1, None, "ab"), (2, "c", "")], "i int, t string, ids string"), lambda: lambda texts: [[ord(c) for c in t] for t in texts], "points", a="t", b="ids")
    assert [tuple(r) for r in loads.orderBy("i").collect()] == [(1, None, "ab", None, [97, 98]), (2, "c", "", [99], [])]


def test_order_by_locale(spark):
    paths = ["src/B.ts", "src/a.ts", "src/á.ts", "src/A.ts", "src/b.ts", "src/Z.ts", "src/ä/x.ts", "src/_.ts"]
    random.Random(1).shuffle(paths)
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r.p for r in df.orderBy(by_locale(F.col("p"))).collect()] == ["src/_.ts", "src/a.ts", "src/A.ts", "src/á.ts", "src/ä/x.ts", "src/b.ts", "src/B.ts", "src/Z.ts"]


def test_texts_are_encoded_in_parts(spark, tmp_path):
    def load():
        def encode(texts):
            (tmp_path / str(random.random())).write_text(str(sum(map(len, texts))))
            return [[len(t), len(t) + 1] for t in texts]

        return encode

    rows = spark.createDataFrame([(i, None if i % 7 == 0 else "a" * (i * 97 % 20_000), "é" * (i % 50)) for i in range(600)], "i int, t string, u string").coalesce(1)
    got = {r.i: (r.x, r.y) for r in chat.encoded(rows, load, "in parts", x="t", y="u").collect()}
    assert got == {i: (None if i % 7 == 0 else [i * 97 % 20_000, i * 97 % 20_000 + 1], [i % 50, i % 50 + 1]) for i in range(600)}
    sizes = [int(f.read_text()) for f in tmp_path.iterdir()]
    assert sum(sizes) > 3_000_000 and max(sizes) <= 600_000
