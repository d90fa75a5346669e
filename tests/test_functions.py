import hashlib
import re

from pyspark.sql import functions as F

from curastra.functions import code, records, text

TEXTS = [
    "",
    "  Let it be. ",
    "a_b $c 12 ÉTÉ été don't re-use",
    "x // tail http://a.b/c\ny /* z\n*/ w\r\nq",
    "no\u00a0break\u2028line // c\u2028still here",
    "٣٤ digits 56 İstanbul",
    "/*/ open",
    "tab\tand\n\nlines\n",
]


def _column(spark, values, expr):
    rows = [(i, v) for i, v in enumerate(values)]
    got = spark.createDataFrame(rows, "i int, t string").select("i", expr(F.col("t")).alias("x")).collect()
    return [r.x for r in sorted(got)]


def test_tokens_and_words_agree_with_python(spark):
    assert [set(x) for x in _column(spark, TEXTS, text.tokens)] == [set(re.findall(r"[a-z_$][a-z0-9_$]*|\d+", t.lower())) for t in TEXTS]
    assert _column(spark, TEXTS, text.words) == [re.findall(r"\b[\w'-]+\b", t) for t in TEXTS]


def test_normalised_code_and_digests(spark):
    def want(t):
        return re.sub(r"\s+", " ", re.sub(r"//.*|/\*[\s\S]*?\*/", "", t)).strip()

    assert _column(spark, TEXTS, text.normalize_code) == [want(t) for t in TEXTS]
    assert _column(spark, TEXTS, text.stripped_digest) == [hashlib.sha256(t.strip().encode()).hexdigest() for t in TEXTS]


def test_small_functions(spark):
    assert _column(spark, ["Foo Bar/baz!", "--a--"], text.slug) == ["foo-bar-baz", "a"]
    assert _column(spark, ["tower-defense-game", "a", "x-Y-z"], text.to_camel) == ["towerDefenseGame", "a", "x-YZ"]
    assert _column(spark, ["a\nb\nc\n"], lambda t: text.line_slice(t, F.lit(2), F.lit(3))) == ["b\nc"]
    assert _column(spark, ["a\nb\nc\n"], lambda t: text.line_slice(t, F.lit(3), F.lit(4))) == [None]
    assert _column(spark, ["key k1  is\nsecret k1"], lambda t: text.redact(t, F.lit("k1"))) == ["key [REDACTED] is secret [REDACTED]"]
    one = spark.range(1)
    row = one.select(text.round_half_even(F.lit(0.03125)).alias("r"), text.backoff_seconds(F.lit(5)).alias("b"), text.jaccard(F.array().cast("array<int>"), F.array().cast("array<int>")).alias("j"), text.coverage(F.array(F.lit("the a")), F.lit("x")).alias("c")).first()
    assert (row.r, row.b, row.j, row.c) == (0.0312, 8.0, 1.0, 0.0)


def _visible(rest):
    """(brackets outside of strings and comments, what never ends)."""
    out = ""
    while rest:
        if rest.startswith("//"):
            rest = rest.partition("\n")[2]
        elif rest.startswith("/*"):
            _, found, rest = rest[2:].partition("*/")
            if not found:
                return out, "comment"
        elif rest[0] in "'\"`":
            quote, rest = rest[0], rest[1:]
            while rest and rest[0] != quote:
                rest = rest[2 if rest[0] == "\\" else 1 :]
            if not rest:
                return out, "string"
            rest = rest[1:]
        else:
            out += rest[0] if rest[0] in "()[]{}" else ""
            rest = rest[1:]
    return out, None


def _delimiters(source):
    """What is wrong, by taking away matching neighbours."""
    brackets, never = _visible(source)
    for k in range(len(brackets)):  # the first closing bracket that matches nothing
        left = brackets[: k + 1]
        while (less := left.replace("()", "").replace("[]", "").replace("{}", "")) != left:
            left = less
        if any(c in ")]}" for c in left):
            return f"unbalanced delimiter {brackets[k]}"
        if k == len(brackets) - 1 and left:
            return "unclosed delimiter"
    return f"unclosed {never}" if never else None


def test_delimiters_against_a_plain_lexer():
    import random

    r = random.Random(3)
    for _ in range(3000):
        s = "".join(r.choice(["(", ")", "{", "}", "[", "]", "'", '"', "`", "\\", "/", "*", "\n", "a"]) for _ in range(r.randint(0, 14)))
        assert code.delimiter_error(s) == _delimiters(s), s


UNIT = """import x
export function play(card: Card): number {
  // a } in a comment
  const s = "}" + '{' + `}`;
  if (s) { return Deck.draw(card) + Math.max(1, 2); }
  return hand.length + Deck.size + Board.width;
}
class Small {}
function todo() {
  // TODO later, this one is long enough to be taken otherwise, really it is, look at it
  return 1;

}
function open( {
"""


def test_units(spark):
    files = spark.createDataFrame([("a.ts", UNIT), ("b.ts", None), ("c.ts", "")], "path string, text string")
    found = code.extract_units(files)
    rows = found.collect()
    assert [(r.path, r.symbol, r.kind, r.start_line, r.end_line) for r in rows] == [("a.ts", "play", "function", 2, 7)]
    assert rows[0].signature == "export function play(card: Card): number"
    one = found.select(code.referenced_symbols(F.col("code"), F.col("symbol")).alias("s"), code.symbol_declared(F.col("code"), F.lit("play")).alias("d"), code.symbol_declared(F.col("code"), F.lit("pl.y")).alias("n"), code.relevance(F.col("code"), F.lit("card")).alias("r"), code.behaviour_check(F.col("code")).alias("b")).first()
    assert one.s == ["Card", "Deck", "Board"] and one.d and not one.n and one.b == "not_eligible"
    assert one.r == 2 * 4 + 1  # card, deck, hand, draw; "return" has a turn in it


def test_extracted_code(spark):
    got = _column(spark, ["text\n```ts\nlet a;\n```\nmore", "Here is it:\nlet b;", "  ", "plain"], code.extract_code)
    assert got == ["let a;\n", "let b;\n", "", "plain\n"]


def test_licences_and_scripts(spark):
    texts = [
        "Apache License\n Version 2.0",
        "Redistribution and use in source and binary forms ... Neither the name of",
        "redistribution and use\nin source and binary forms",
        'Permission is hereby granted, free of charge, ... THE SOFTWARE IS PROVIDED "AS IS"',
        "MIT License",
    ]
    assert _column(spark, texts, records.detect_license) == ["Apache-2.0", "BSD-3-Clause", "BSD-2-Clause", "MIT", "UNKNOWN"]
    scripts = [{"compile": "x", "build": "y"}, {"zbuild": "a", "build:dev": "b"}, {"test": "a", "build": None}, {}]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(scripts)], "i int, s map<string,string>").select("i", records.choose_build_script(F.col("s")).alias("x")).collect()
    assert [r.x for r in sorted(rows)] == ["build", "build:dev", None, None]
    assert spark.range(1).select(records.first_license_file(F.array(F.lit("COPYING"), F.lit("LICENSE.md")))).first()[0] == "LICENSE.md"


def test_model_answers(spark):
    assert _column(spark, ["SUCCESS: done ", " FAILURE:no", "done"], records.final_answer) == [("success", "done"), ("failure", "no"), None]
    body = '{"output":[{"content":[{"type":"output_text","text":"a"},{"type":"x"}]},{"type":"r"},{"content":[{"type":"output_text","text":"b"}]}]}'
    assert _column(spark, [body, '{"output":[]}'], records.output_text) == ["a\nb", None]
    assert _column(spark, ['{"error":{"code":"slow"}}', "no json", '{"error":1}'], records.http_error_code) == ["slow", None, None]


def test_tool_calls(spark):
    good = ['{"tool":"read_file","path":"a"}', '{"tool":"write_file","path":"a","content":""}', '{"tool":"run_command","command":"node","args":["x"],"timeoutMs":30000}', '{"tool":"run_command","command":"node","args":[]}']
    bad = ['{"tool":"read_file","path":" "}', '{"tool":"read_file","path":"a","x":1}', '{"tool":"write_file","path":"a","content":1}', '{"tool":"run_command","command":"n","args":[1]}', '{"tool":"run_command","command":"n","args":["a"],"timeoutMs":0}', '{"tool":"run_command","command":"n","args":["a"],"timeoutMs":"5"}', '{"tool":"rm"}', "[]", "no", None]
    assert _column(spark, good + bad, records.valid_tool_call) == [True] * len(good) + [False] * len(bad)
    assert _column(spark, ["a/b", "/a", "../a", "a/../b", "C:\\a"], records.inside_workspace) == [True, False, False, False, False]


def test_strip_takes_all_blanks_of_the_pattern(spark):
    points = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x11000)]]
    texts = [c + "a" + c + "b" + c + c for c in points] + ["", " \t\n", "　 \x85", "a", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old = F.regexp_replace("t", r"(?U)^\s+|\s+\z", "")
    assert df.where(~text.strip(F.col("t")).eqNullSafe(old)).count() == 0
    assert text.BLANKS and df.where(F.col("t").rlike(r"(?U)^\s")).select(F.countDistinct(F.left("t", F.lit(1)))).first()[0] == len(text.BLANKS)


def test_tokens_of_code_without_comments_need_no_squeezing(spark):
    texts = ["a  b // c\n d/* x\ny */e", "İ　x1 2٣ //", "/* */", "  KK ΣσΣ q", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.where(text.tokens(text.uncommented(F.col("t"))) != text.tokens(text.normalize_code(F.col("t")))).count() == 0
