"""Literals as JSON: numbers, strings, keys, holes; what isn't a literal; behaviour of functions."""

import json

import pytest
from pyspark.sql import functions as F

from curastra.functions import literals as lit
from curastra.plans import curation


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("1", "1"), ("-0", "0"), ("1.50", "1.5"), (".5e1", "5"), ("5.", "5"), ("1e21", "1e+21"), ("123456789012345680000", "123456789012345680000"), ("1e-7", "1e-7"), ("0.000001", "0.000001"), ("0xFF", "255"), ("0b11", "3"), ("0o17", "15"), ("1_000", "1000"), ("1e400", "null"), ("NaN", "null"), ("- 2", "-2"), ("0.1", "0.1"), ("5e-324", "5e-324"),
        ("!0", "true"), ("!''", "true"), ("![]", "false"), ("!!1", "true"), ("null", "null"),
        ("'a\\'b'", '"a\'b"'), ('"\\u{1F600}\\x41\\n\\q"', '"😀A\\nq"'), ("'\\ud83d\\ude00'", '"😀"'), ("'\\ud800'", '"\\ud800"'), ("'a\\\nb'", '"ab"'), ("'\\0'", '"\\u0000"'),
        ("[1,,2,]", "[1,null,2]"), ("[undefined, [ ]]", "[null,[]]"), ("[,]", "[null]"),
        ("{b: 1, 'a-c': [true], 2: 0, 1: 'x', u: undefined,}", '{"1":"x","2":0,"b":1,"a-c":[true]}'), ("{a: 1, a: 2}", '{"a":2}'), ("{ }", "{}"), ("{1.5: 0, 0x10: 1}", '{"16":1,"1.5":0}'), ("{true: 1}", '{"true":1}'),
        ("/* c */ 7 // d", "7"),
    ],
)
def test_values(text, want):
    assert lit.to_json(text) == want
    json.loads(want)


@pytest.mark.parametrize("text", ["", "undefined", "x", "1 + 2", "[1", "{a}", "{a:1", "'a", "'a\nb'", "1 2", "--1", "+'a'", "010", "1__0", "`t`", "{...a}", "[1] as const", "'\\u12'", "3px", "{__proto__: 1}", "[" * 300 + "]" * 300, "0x", "1e"])
def test_no_values(text):
    assert lit.to_json(text) is None


def test_long_literals_are_read():
    long = "[" + ",".join(f"{{k: '{i}', v: [{i}, -{i}.5]}}" for i in range(30_000)) + "]"
    assert len(json.loads(lit.to_json(long))) == 30_000


def test_behaviour_of_targets(spark):
    rows = [
        ("function f() { return 5; }", "f", "pass", "pass", "5"),
        ("export function f( )\n{\n  return { a: [1, 'x'], }\n}\n", "f", "pass", "pass", '{"a":[1,"x"]}'),
        ("function f(): number { return 5; }", "f", "pass", "fail", None),
        ("export default function f() { return 5; }", "f", "pass", "fail", None),
        ("async function f() { return 5; }", "f", "pass", "fail", None),
        ("async function f() { return {}; }", "f", "pass", "pass", "{}"),
        ("function f() { return g(); }", "f", "pass", "not_eligible", None),
        ("function f(a) { return 5; }", "f", "pass", "not_eligible", None),
        ("function f() { return a; }", "f", "pass", "not_eligible", None),
        ("function f() { return [1; }", "f", "fail", "not_eligible", None),
        ("function g() { return 1; }", "f", "pass", "not_eligible", None),
        ("class f { m() { return 1; } }", "f", "pass", "not_eligible", None),
        (None, "f", "pass", "not_eligible", None),
    ]
    units = spark.createDataFrame([(str(i), "h", t, s) for i, (t, s, *_) in enumerate(rows)], "unit_id string, target_sha256 string, target string, symbol string")
    got = {int(r.unit_id): r for r in curation.validate_targets(units).collect()}
    for i, (_, _, syntax, behaviour, value) in enumerate(rows):
        r = got[i]
        assert (r.syntax, r.behavior, r.behavior_test and r.behavior_test.expected_json) == (syntax, behaviour, value), i
        assert (behaviour == "fail") == any(x.startswith(curation.HARNESS) for x in r.reasons)


def test_a_failed_behaviour_rejects(spark):
    from curastra.operators.gates import deterministic_reasons
    from tests.test_operators import GOOD, KINDS

    targets = {"a": "function playCard(): X { return 1; }", "b": "function playCard() { return 1; }"}
    units = spark.createDataFrame([(i, "t", t, "playCard") for i, t in targets.items()], "unit_id string, target_sha256 string, target string, symbol string")
    records = spark.createDataFrame([(i, tuple(GOOD.values())) for i in targets], f"unit_id string, r struct<{', '.join(k.replace(' ', ':', 1) for k in KINDS.split(', '))}>")
    judged = curation.validate_targets(units).select("unit_id", F.struct("target_sha256", "syntax", "symbol", "behavior").alias("v")).join(records, "unit_id")
    assert {x.unit_id: x.why for x in judged.select("unit_id", deterministic_reasons(F.col("r"), F.col("v")).alias("why")).collect()} == {"a": ["DETERMINISTIC_BEHAVIOR_FAILED"], "b": []}


@pytest.mark.parametrize(
    ("code", "want"),
    [("'at this (new) await; `x`'", '"at this (new) await; `x`"'), ('{"k": "it\'s process", \'(\': [\'a"this"\']}', '{"k":"it\'s process","(":["a\\"this\\""]}'), ("['a', this]", None), ("'a' /* new */", None), ("'a'; 'b'", None), ("('a')", None), ("require('a')", None)],
)
def test_words_in_strings_are_no_code(code, want):
    assert lit.returned_json(f"function f() {{ return {code}; }}", "f") == (("pass", want, None) if want else ("not_eligible", None, None))
