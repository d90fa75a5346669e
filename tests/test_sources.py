"""Order over files of different sizes, writes that fail, lines of large files."""

import json

import pytest
from pyspark.sql import functions as F

from curastra.functions.code import extract_units
from curastra.sources import jsonl, sinks


def test_rows_are_numbered_in_order_of_files(spark, tmp_path):
    for name, first, n in (("a", 0, 3), ("b", 3, 2000), ("c", 2003, 40)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"v": first + k}) + "\n" for k in range(n)))
    rows = jsonl.with_seq(jsonl.read_jsonl(spark, str(tmp_path), "v long")).collect()
    assert sorted((r.v, r.seq) for r in rows) == [(k, k) for k in range(2043)]
    assert rows[0].asDict().keys() == {"v", "seq"}


def test_parts_are_numbered_by_their_number(spark, tmp_path):
    for part in (9, 99_999, 100_000):
        (tmp_path / f"part-{part:05d}-x.json").write_text(json.dumps({"v": part}) + "\n")
    rows = jsonl.with_seq(jsonl.read_jsonl(spark, str(tmp_path), "v long")).collect()
    assert [r.v for r in sorted(rows, key=lambda r: r.seq)] == [9, 99_999, 100_000]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        (tmp_path / "x.txt").write_text("".join(f"line {k}\r\n" if k % 5 else "\n" for k in range(1, 1001)))
        (tmp_path / "y.txt").write_text("one\n\ntwo")
        rows = jsonl.read_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 1
        got = {(r.path.rsplit("/", 1)[1], r.line): r.text for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {k: v for k, v in got.items() if k[0] == "y.txt"} == {("y.txt", 1): "one", ("y.txt", 3): "two"}
    assert {k[1]: v for k, v in got.items() if k[0] == "x.txt"} == {k: f"line {k}" for k in range(1, 1001) if k % 5}


def test_a_failed_write_keeps_what_was_there(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_jsonl(spark.range(3), path)
    with pytest.raises(Exception, match="(?i)bad row"):
        sinks.write_jsonl(spark.range(5).select(F.when(F.col("id") < 4, F.col("id")).otherwise(F.raise_error(F.lit("bad row")))), path)
    assert sorted(r.id for r in spark.read.json(path).collect()) == [0, 1, 2]
    sinks.write_jsonl(spark.range(2), path)
    assert spark.read.json(path).count() == 2 and [p.name for p in tmp_path.iterdir()] == ["out"]


def test_sinks_report_and_order(spark):
    df = spark.createDataFrame([(2, None), (1, "x")], "seq int, v string")
    assert [r.seq for r in sinks.in_input_order(df).collect()] == [1, 2]
    assert [json.loads(r.report) for r in sinks.report(df.where("seq = 2")).collect()] == [{"seq": 2, "v": None}]


def test_json_array_and_task_ids(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"v": 1}, {"v": 2}]')
    assert sorted(r.v for r in jsonl.read_json_array(spark, str(tmp_path / "a.json"), "v int").collect()) == [1, 2]
    (tmp_path / "b.ts").write_text("test('H1_MOVE', H12_DRAW_CARD, H1_MOVE)")
    assert {r.task_id for r in jsonl.task_ids(spark, [str(tmp_path / "b.ts")]).collect()} == {"H1_MOVE", "H12_DRAW_CARD"}


def test_units_with_braces_in_strings_and_comments(spark):
    body = "  const a = '}';\n  // }\n  if (x) {\n    return `{${a}`;\n  }\n  /* { */ return a + \"a long enough line to be kept as a unit of code\";\n"
    text = f"const z = 1;\n\nexport  async function  move(x: number) {{\n{body}}}\n\nabstract class Deck extends Base {{\n  cards: string[] = [];\n{body}}}\nfunction open() {{\n{body}"
    rows = [(0, text), (1, text.replace("// }", "// TODO }")), (2, None), (3, "")]
    got = sorted(map(tuple, extract_units(spark.createDataFrame(rows, "i int, text string")).collect()), key=lambda u: u[5])
    assert [(u[0], u[1], u[2], u[3], u[5], u[6]) for u in got] == [(0, "move", "function", "export async function move(x: number)", 3, 10), (0, "Deck", "class", "abstract class Deck extends Base", 12, 20)]
    assert all(text.count(u[4]) == 1 for u in got)


def test_units_nest_and_stray_signs_end_with_their_line(spark):
    inner = "    return 'a line that is long enough' + n + ' for a unit of code that is to be kept';\n    // and more\n"
    text = f"""// function old() {{
const quote = /['"]/; const it = "don't";
  function outer(
    a: number, // first; second {{
    b = {{ c: 1 }}) {{ return a; }}
export default class Größe {{}}
class Board {{
  function inner(n: number) {{
{inner}  }}
}}
}} function notAtTheStart() {{
{inner}}}
"""
    got = extract_units(spark.createDataFrame([(text, 1, "k")], "text string, symbol int, other string")).orderBy("start_line")
    assert got.columns == ["other", "symbol", "kind", "signature", "code", "start_line", "end_line"]
    assert [(u.symbol, u.kind, u.signature, u.start_line, u.end_line) for u in got.collect()] == [("Board", "class", "class Board", 7, 12), ("inner", "function", "function inner(n: number)", 8, 11)]
    assert got.where("symbol = 'inner'").first().code == f"function inner(n: number) {{\n{inner}  }}"
