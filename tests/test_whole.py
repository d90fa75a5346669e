"""Queries over tables that are larger, longer or stranger than the test tables: nothing is left out."""

from pyspark.sql import functions as F

from curastra.plans import queries


def test_numbered_ids_number_every_document(spark, tmp_path):
    rows = [(i, "b" if i % 2 else "a") for i in range(4996, 5006)]
    spark.createDataFrame(rows, "doc_id long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.unit_id for r in queries.numbered_ids(spark, str(tmp_path)).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert got == {i: f"scale-{s}-{k:04d}" for k, (i, s) in enumerate(order, 1)}


def _events(spark, path, n=240):
    rows = [(i, i % 12, f"e{i % 5}", float(i % 50)) for i in range(n)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{path}/events.parquet")
    return rows


def test_tools_of_every_task(spark, tmp_path):
    rows = _events(spark, tmp_path)
    got = {(r.task_id, r.attempt): r.tools for r in queries.tools_by_attempt(spark, str(tmp_path)).collect()}
    want = {}
    for i, user, kind, _ in rows:
        want.setdefault((user, i % 2), []).append(kind)
    assert got == {k: ",".join(v) for k, v in want.items()}


def test_every_event_has_a_role_in_the_rollup(spark, tmp_path, monkeypatch):
    rows, given = _events(spark, tmp_path), []
    whole = queries.metrics.task_rollup
    monkeypatch.setattr(queries.metrics, "task_rollup", lambda attempts, events: given.append((attempts.count(), events.count())) or whole(attempts, events))
    out = queries.task_rollup(spark, str(tmp_path)).agg(F.sum("tool_calls")).first()[0]
    users = {u for i, u, *_ in rows if i % 3 == 0}
    assert sum(given[0]) == len(rows) and out == sum(1 for i, u, *_ in rows if i % 3 == 1 and u in users)


def test_long_conversations_are_rendered_and_masked(spark, tmp_path):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", "" if t % 3 else f"t{t}") for t in range(200)] + [(2, 0, "user", "q"), (2, 1, "assistant", "a")]
    rows += [(3, t, "user" if t % 2 == 0 else "assistant", "x" * 700) for t in range(80)] + [(4, t, "", None if t % 2 else "y") for t in range(90)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    show = lambda r, t: f"<|im_start|>{r}\n{t}<|im_end|>\n"
    whole = {c: "".join(show(r, t) for k, _, r, t in rows if k == c and t is not None) for c in (1, 2, 3, 4)}
    prompt = {c: next(show(r, t) for k, _, r, t in rows if k == c) + "<|im_start|>assistant\n" for c in (1, 2, 3, 4)}
    assert {r.conv_id: r.rendered for r in queries.chat_render(spark, str(tmp_path)).collect()} == whole
    got = {r.conv_id: (r.n_ids, r.n_labels, r.error) for r in queries.response_mask(spark, str(tmp_path)).collect()}
    for c, text in whole.items():
        n, p = min(len(text), 512), len(prompt[c])
        error = "the prompt is no prefix" if not text.startswith(prompt[c]) else "nothing of the response is left" if n <= p else None
        assert got[c] == (n, max(n - p, 0), error), c


def test_every_script_of_a_page(spark, tmp_path):
    pages = [(1, "u", "<script>function a() { return 1 }</script><p><script>\nfunction b( {\n</script>"), (2, "u", "<p>none"), (3, "u", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id, r.error is not None) for r in queries.delimiter_check(spark, str(tmp_path)).collect())
    assert got == [(1, False), (1, True), (2, False), (3, False)]


def test_instructions_have_the_whole_text(spark, tmp_path, monkeypatch):
    docs = [(i, "It moves. " * 60 + f"end{i}", "en", "s", 604) for i in range(2)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    given, whole = [], queries.curation.finalize
    monkeypatch.setattr(queries.curation, "finalize", lambda units, told, *a: given.extend(r.instruction for r in told.collect()) or whole(units, told, *a))
    queries.curated_samples(spark, str(tmp_path))
    assert sorted(x.endswith(f"end{i}.") for i, x in enumerate(sorted(given))) == [True, True]


def test_records_of_instructions_carry_no_target(spark, tmp_path, monkeypatch):
    docs = [(i, "It moves. " * 60 + f"end{i}", "en", "s", 604) for i in range(2)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    records, whole = [], queries.curation.with_evidence
    monkeypatch.setattr(queries.curation, "with_evidence", lambda *a, **k: records.append(k["i"].schema["record"].dataType.names) or whole(*a, **k))
    queries.curated_samples(spark, str(tmp_path))
    assert all("target" not in names and "instruction" in names for names in records) and records  # texts were shuffled twice for it


def test_samples_shuffle_no_texts_that_nobody_reads(spark, tmp_path):
    docs = [(i, "It moves. " * 60 + f"end{i}", "en", "s", 604) for i in range(3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    plan = queries.curated_samples(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "max_by" not in plan  # the evidence was joined again, with its texts
    assert plan.count("labels.parquet") == 0 and plan.count("documents.parquet") <= 2


def test_gates_with_columns_at_hand_say_the_same(spark):
    gates, functions = queries.gates, queries.text
    says = ["", "Write play.", "The WHOLE game. " * 50, "complete Project", "complete  game", "Complete game!", "G1 code unit guidelines?", "as Described above", "ſpecified requirements", "PROVIDED GUIDELINES", "fuK all files all files", "Above implementation of Repository. İ", None]
    scope = "struct<target_file: string, target_symbol: string, expected_behavior: array<string>, constraints: array<string>, required_context: array<string>>"
    record = f"struct<instruction: string, generation: struct<pipeline_version: string, response_completed: boolean>, scope: {scope}, source_path: string, symbol: string, provided_symbols: array<string>, target_sha256: string, granularity: string>"
    rows = [((t, ("quality-v2", True), ("a", "Play", ["write play", "the game"], ["whole guidelines"], ["c"]), "a", "Play", ["c"], "s", "G1"), ("s", "pass", "pass", "pass")) for t in says]
    df = spark.createDataFrame(rows, f"r {record}, v struct<target_sha256: string, syntax: string, symbol: string, behavior: string>")
    df = df.withColumns({"low": F.lower("r.instruction"), "held": functions.tokens(F.col("r.instruction"))})
    both = df.select(gates.deterministic_reasons(F.col("r"), F.col("v")).alias("a"), gates.deterministic_reasons(F.col("r"), F.col("v"), F.col("low"), F.col("held")).alias("b")).collect()
    assert all(x.a == x.b for x in both) and any("GRANULARITY_MISMATCH" in x.a for x in both) and any("UNDERSPECIFIED_REFERENCE" in x.a for x in both)
