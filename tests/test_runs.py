"""Runs in batch and as a stream against a plain loop; requests and answers; outputs in order."""

import json
import random

import pytest
from pyspark.sql import functions as F

from curastra.operators import correlate, runs
from curastra.streaming import resume
from curastra.streaming import runs as streamed


def plain(outputs, most=runs.ITERATIONS, limit=runs.CALLS):
    executed, refused, first, refusal = 0, 0, None, None
    for at in range(1, most + 1):
        if at not in outputs:
            return ("running", None, max(outputs), executed, refused, first, refusal)
        kind, calls, status, message = outputs[at]
        if kind == "error":
            return ("failure", "model error" if message is None else f"model error: {message}", at, executed, refused, first, refusal)
        if kind == "final":
            return (status, message, at, executed, refused, first, refusal)
        if calls and calls <= limit:
            executed += calls
        else:
            refused += 1
            if first is None:
                first, refusal = at, f"model returned {calls} tool calls; limit is {limit} per iteration" if calls else "model returned an empty tool call batch"
    return ("max_iterations", f"agent stopped after reaching the {most} iteration limit", most, executed, refused, first, refusal)


def _outputs(n):
    r = random.Random(n)
    made = {}
    for k in range(n):
        kinds = [r.choices(["tool_calls", "final", "error"], [8, 1, 1])[0] for _ in range(r.randint(1, 9))]
        made[f"r{k}"] = {i: (kind, r.choice([None, 0, 1, 3, 8, 9, 40]) if kind == "tool_calls" else None, r.choice(["success", "failure"]) if kind == "final" else None, r.choice([None, "why"])) for i, kind in enumerate(kinds, 1)}
    return made


def test_runs_in_batch(spark):
    made = _outputs(150)
    rows = [(run, i, *o) for run, own in made.items() for i, o in own.items()]
    random.Random(3).shuffle(rows)
    got = {r.run_id: tuple(r)[1:] for r in runs.outcomes(spark.createDataFrame(rows, runs.OUTPUTS)).collect()}
    assert got == {run: plain(own) for run, own in made.items()}
    assert {v[0] for v in got.values()} == {"success", "failure", "max_iterations", "running"}
    assert runs.outcomes(spark.createDataFrame([], runs.OUTPUTS)).collect() == []
    with pytest.raises(ValueError, match="positive"):
        runs.outcomes(spark.createDataFrame([], runs.OUTPUTS), most=0)


def test_runs_as_a_stream_out_of_order_and_repeated(spark, tmp_path):
    made = _outputs(60)
    rows = [dict(zip(("run_id", "iteration", "kind", "calls", "status", "message"), (run, i, *o), strict=True)) for run, own in made.items() for i, o in own.items()]
    random.Random(4).shuffle(rows)
    source = tmp_path / "in"
    source.mkdir()
    third = len(rows) // 3
    for k in range(3):  # some rows come twice, in a later batch
        part = rows[k * third : (k + 1) * third if k < 2 else None] + rows[: 5 * k]
        (source / f"{k}.json").write_text("".join(json.dumps(x) + "\n" for x in part))
        stream = spark.readStream.schema(runs.OUTPUTS).json(str(source))
        query = streamed.outcomes(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    want = {run: plain(own) for run, own in made.items()}
    assert {r.run_id: tuple(r)[1:] for r in got} == {run: v for run, v in want.items() if v[0] != "running"}
    assert len(got) == len({r.run_id for r in got})


T0 = 1_000_000
REQUESTS = [("a", 0, "q"), ("b", 5, "q"), ("c", 10, "q"), ("d", 20, "q"), (None, 21, "q"), ("g", 22, "q")]
ANSWERS = [("b", 9, "x"), ("a", 3, "first"), ("a", 4, "again"), ("c", 60, "too late"), ("e", 30, "nobody asked"), (None, 31, "x"), ("g", 20, "before")]


def _timed(spark, rows, body):
    return spark.createDataFrame(rows, f"id string, s int, {body} string").select("id", F.timestamp_seconds(F.col("s") + T0).alias("at"), body)


def test_outcomes_of_requests(spark):
    got = {r.id: (r.outcome, r.on_time, r.late, r.early) for r in correlate.outcomes(_timed(spark, REQUESTS, "request"), _timed(spark, ANSWERS, "answer"), 10).collect()}
    assert got == {"a": ("repeated", 2, 0, 0), "b": ("answered", 1, 0, 0), "c": ("late", 0, 1, 0), "d": ("missing", 0, 0, 0), "e": ("unknown", 0, 0, 0), "g": ("missing", 0, 0, 1)}


def test_correlation_is_the_same_in_a_stream(spark, tmp_path):
    far = 10_000  # rows that move the watermark past all others
    batches = [(REQUESTS[:3], ANSWERS[:1]), (REQUESTS[3:], ANSWERS[1:]), ([("z", far, "q")], [("y", far, "x")]), ([("z2", 2 * far, "q")], [("y2", 2 * far, "x")])]
    for name in ("requests", "answers"):
        (tmp_path / name).mkdir()

    def stream(name, body):
        rows = spark.readStream.schema(f"id string, s int, {body} string").json(str(tmp_path / name))
        return rows.select("id", F.timestamp_seconds(F.col("s") + T0).alias("at"), body).withWatermark("at", "1 minute")

    for k, both in enumerate(batches):
        for name, body, rows in zip(("requests", "answers"), ("request", "answer"), both, strict=True):
            (tmp_path / name / f"{k}.json").write_text("".join(json.dumps({"id": i, "s": s, body: b}) + "\n" for i, s, b in rows))
        pairs = correlate.correlated(stream("requests", "request"), stream("answers", "answer"), 10)
        pairs.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).where(f"coalesce(asked_at, answered_at) < timestamp_seconds({far + T0})")
    want = correlate.correlated(_timed(spark, REQUESTS, "request"), _timed(spark, ANSWERS, "answer"), 10)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_an_output_in_order_is_merged_by_bucket(spark, tmp_path):
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    work = lambda df: df.withColumn("v", F.col("v") * 10)
    rows = lambda *pairs: "".join(json.dumps({"seq": s, "id": f"k{s}", "v": v}) + "\n" for s, v in pairs)
    (source / "1.json").write_text(rows((25, 1), (3, 1), (11, 1), (3, 9)))
    resume.run_ordered(spark, str(source), "seq long, id string, v long", work, "id", out, state, per_bucket=10)
    times = {p.parent.name: p.stat().st_mtime_ns for p in (tmp_path / "out").glob("bucket=*/*.parquet")}
    assert sorted(times) == ["bucket=0", "bucket=1", "bucket=2"]
    (source / "2.json").write_text(rows((1, 2), (3, 0), (14, 2), (13, 2)))
    resume.run_ordered(spark, str(source), "seq long, id string, v long", work, "id", out, state, per_bucket=10)
    files = {p.parent.name: p for p in (tmp_path / "out").glob("bucket=*/*.parquet")}
    assert files["bucket=2"].stat().st_mtime_ns == times["bucket=2"]  # neither read nor written
    in_order = [(r.seq, r.v) for b in sorted(files, key=lambda b: int(b[7:])) for r in spark.read.parquet(str(files[b])).collect()]
    assert in_order == [(1, 20), (3, 10), (11, 10), (13, 20), (14, 20), (25, 10)]  # files one after the other, without a sort
    again = spark.createDataFrame([(25, "k25", 7), (26, "k26", 5), (26, "k26", 4)], "seq long, id string, v long")
    for _ in range(2):
        resume.merge_ordered(again, out, "id", per_bucket=10)
    got = resume.read_ordered(spark, out, start=14, end=40, per_bucket=10)
    assert sorted((r.seq, r.v) for r in got.collect()) == [(14, 20), (25, 10), (26, 4)]
    assert "bucket" in got._jdf.queryExecution().toString().split("PartitionFilters")[1][:200]
