"""Queries over records derived from the standard tables, with DuckDB SQL that judges the same records.

The records' fields vary with ``doc_id`` so that every gate and form of an answer occurs. They
are written once, as expressions both engines read (``Fields``); what is made of them is
expressed twice, by the library's functions and in SQL.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code, merge, records, text
from ..operators import chat, correlate, gates, integrity, joins, metrics, ordering, runs
from ..operators import records as rows_of
from ..operators.components import shared_folder
from ..sources import jsonl, sinks
from . import curation
from .queries import _GATES, _TOKENS, _quote, query, table


class Fields:
    """Named expressions over ``documents``; ``array(...)`` is the only word that differs in DuckDB."""

    def __init__(self, **expressions: str) -> None:
        self.expressions = expressions

    def rows(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "documents").select("doc_id", *(F.expr(e).alias(n) for n, e in self.expressions.items()))

    @property
    def sql(self) -> str:
        return "SELECT doc_id, " + ", ".join(f"{e.replace('array(', 'list_value(')} AS {n}" for n, e in self.expressions.items()) + " FROM documents"


def pick(modulus: int, *values: str, otherwise: str = "NULL") -> str:
    """The value at ``doc_id % modulus``."""
    return f"CASE doc_id % {modulus} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + f" ELSE {otherwise} END"


def _joined(array: Column) -> Column:
    return F.array_join(array, ",")


def _sorted(*cases: str) -> str:
    return f"array_to_string(list_sort(list_filter([{', '.join(cases)}], lambda r: r IS NOT NULL)), ',')"


def _when(reason: str, condition: str) -> str:
    return f"CASE WHEN {condition} THEN '{reason}' END"


# --- gates -------------------------------------------------------------------------------

_MOVES = "array('moves every card')"
_RECORD = Fields(
    text="CASE WHEN doc_id % 29 = 0 THEN NULL ELSE 'In src/a.ts write play so that it moves every card. ' || text || " + pick(4, "','", otherwise="'.'") + " END",
    no_scope="doc_id % 31 = 0",
    version=pick(7, "'quality-v1'", "NULL", otherwise=f"'{gates.PIPELINE}'"),
    completed=pick(11, "false", "NULL", otherwise="true"),
    target_file=pick(5, "'src/b.ts'", otherwise="'src/a.ts'"),
    symbol=pick(6, "'shuffle'", "'PLAY'", otherwise="'play'"),
    target_symbol=pick(6, "'shuffle'", "'PLAY'", "'draw'", otherwise="'play'"),
    behaviour=pick(9, _MOVES, "array()", "NULL", "array('moves every card', ' ')", "array('moves', 'every', 'card', 'play', 'write', 'moves', 'card')", "array('qqqa qqqb qqqc moves')", otherwise=_MOVES),
    constraints=pick(8, "array('write play')", "array()", "NULL", "array('write', NULL)", "array('a', 'b', 'c', 'd', 'e', 'f', 'g')", "array('qqqa qqqb qqqc qqqd qqqe play')", otherwise="array('write play')"),
    context=pick(10, "array('Card')", "array('Card', 'Deck')", "NULL", "array('Card', NULL)", "array()", otherwise="array('Card')"),
    provided=pick(3, "NULL", otherwise="array('Card', 'Pile')"),
    granularity=pick(2, "'G1'", otherwise="'G2'"),
    sha="'t' || doc_id",
    validated=pick(12, "NULL", "'stale'", otherwise="'t' || doc_id"),
    syntax=pick(12, "'pass'", "'pass'", "'fail'", "NULL", otherwise="'pass'"),
    declared=pick(12, "'pass'", "'pass'", "'pass'", "'pass'", "'fail'", otherwise="'pass'"),
    behavior=pick(12, "'pass'", "'fail'", "'pass'", "'pass'", "'pass'", "'fail'", "'not_eligible'", otherwise="'pass'"),
)


def _content(of: str) -> str:
    return f"list_filter({_TOKENS.format(of)}, lambda w: w NOT IN ({_quote(text.STOP_WORDS)}))"


def _covered(parts: str) -> str:
    expected = _content(f"array_to_string({parts}, ' ')")
    return f"CASE WHEN len({expected}) = 0 THEN 0.0 ELSE len(list_intersect({expected}, {_content('text')})) / len({expected}) END"


def _filled(values: str, most: int) -> str:
    return f"coalesce(len({values}) BETWEEN 1 AND {most} AND len(list_filter({values}, lambda v: v IS NULL OR trim(v) = '')) = 0, false)"


_UNFINISHED = _when("GENERATION_INCOMPLETE", f"version IS DISTINCT FROM '{gates.PIPELINE}' OR completed IS NOT TRUE")
_EVERY_GATE = [
    _UNFINISHED,
    *_GATES.rsplit(",\n", 1)[:1],
    _when("TARGET_FILE_SCOPE_MISMATCH", "target_file <> 'src/a.ts'"),
    _when("TARGET_SYMBOL_SCOPE_MISMATCH", "target_symbol <> symbol OR NOT contains(lower(text), lower(symbol))"),
    _when("EXPECTED_BEHAVIOR_MISSING", "NOT has_behaviour"),
    _when("EXPECTED_BEHAVIOR_NOT_IN_INSTRUCTION", f"has_behaviour AND {_covered('behaviour')} < 0.35"),
    _when("CONSTRAINTS_MISSING", "NOT has_constraints"),
    _when("CONSTRAINTS_NOT_IN_INSTRUCTION", f"has_constraints AND {_covered('constraints')} < 0.20"),
    _when("REQUIRED_CONTEXT_INVALID", "NOT context_ok"),
    _when("MISSING_CONTEXT", "context_ok AND len(list_filter(context, lambda c: NOT list_contains(coalesce(provided, []), c))) > 0"),
    _when("GRANULARITY_MISMATCH", f"regexp_matches(text, '{gates.TOO_WIDE}') OR (granularity = 'G1' AND len(behaviour) > 6)"),
    _when("TARGET_VALIDATION_MISSING", "NOT valid"),
    _when("TARGET_SYNTAX_INVALID", "valid AND syntax IS DISTINCT FROM 'pass'"),
    _when("TARGET_SYMBOL_INVALID", "valid AND declared IS DISTINCT FROM 'pass'"),
    _when("DETERMINISTIC_BEHAVIOR_FAILED", "valid AND behavior = 'fail'"),
]


@query(f"""WITH r AS ({_RECORD.sql}), j AS (SELECT *, {_filled("behaviour", 8)} AS has_behaviour, {_filled("constraints", 6)} AS has_constraints,
  coalesce(len(list_filter(context, lambda c: c IS NULL)) = 0, false) AS context_ok, coalesce(validated = sha, false) AS valid FROM r)
SELECT doc_id, CASE WHEN text IS NULL THEN {_sorted(_UNFINISHED, "'INSTRUCTION_INVALID'")} WHEN no_scope THEN {_sorted(_UNFINISHED, "'SCOPE_MISSING'")}
  ELSE {_sorted(*_EVERY_GATE)} END AS reasons FROM j""")
def instruction_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every deterministic gate over a record for each document."""
    c = F.col
    scope = F.when(~c("no_scope"), F.struct("target_file", "target_symbol", c("behaviour").alias("expected_behavior"), "constraints", c("context").alias("required_context")))
    generation = F.struct(c("version").alias("pipeline_version"), c("completed").alias("response_completed"))
    record = F.struct(c("text").alias("instruction"), scope.alias("scope"), generation.alias("generation"), F.lit("src/a.ts").alias("source_path"), "symbol", c("provided").alias("provided_symbols"), "granularity", c("sha").alias("target_sha256"))
    validation = F.struct(c("validated").alias("target_sha256"), "syntax", c("declared").alias("symbol"), "behavior")
    rows = _RECORD.rows(spark, sf_dir).select("doc_id", record.alias("r"), validation.alias("v"))
    return rows.select("doc_id", _joined(gates.deterministic_reasons(c("r"), c("v"))).alias("reasons"))


_REVIEW = Fields(
    missing="doc_id % 7 = 0",
    sha="'t' || doc_id",
    reviewed=pick(8, "'stale'", "NULL", otherwise="'t' || doc_id"),
    version=pick(9, "'strong-review-v1'", otherwise=f"'{gates.STRONG_REVIEW}'"),
    reviewer=pick(5, f"'{gates.DETERMINISTIC}'", otherwise="'m'"),
    decision=pick(4, "'fail'", "NULL", otherwise="'pass'"),
    failed=pick(3, "NULL", "'behavior'", otherwise="'scope'"),
    said=pick(6, "NULL", "array('INSTRUCTION_LENGTH', 'MISSING_CONTEXT')", otherwise="array()"),
    alignment=pick(10, "'fail'", "'invalid'", otherwise="'pass'"),
    solvability=pick(11, "'fail'", "NULL", otherwise="'pass'"),
    parsed=pick(13, "false", "NULL", otherwise="true"),
)


@query(f"""WITH r AS ({_REVIEW.sql}) SELECT doc_id, CASE WHEN missing THEN 'STRONG_REVIEW_MISSING'
  WHEN reviewed IS DISTINCT FROM sha OR version <> '{gates.STRONG_REVIEW}' THEN 'STRONG_REVIEW_INVALID'
  WHEN decision IS DISTINCT FROM 'pass' THEN CASE WHEN len(said) > 0 THEN array_to_string(said, ',') ELSE 'STRONG_REVIEW_' || upper(coalesce(failed, 'other')) END
  WHEN reviewer <> 'm' THEN 'STRONG_REVIEW_MISSING' ELSE '' END AS strong,
  CASE WHEN missing OR parsed IS NOT TRUE THEN 'INDEPENDENT_REVIEW_INVALID' WHEN reviewed IS DISTINCT FROM sha THEN 'INDEPENDENT_REVIEW_TARGET_MISMATCH'
  WHEN alignment <> 'pass' OR solvability IS DISTINCT FROM 'pass' THEN 'INDEPENDENT_REVIEW_FAILED' ELSE '' END AS independent FROM r""")
def review_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both versions' review gates over a review for each document."""
    c = F.col
    review = F.struct(c("reviewed").alias("target_sha256"), c("version").alias("review_version"), "reviewer", "decision", c("failed").alias("failed_check"), c("said").alias("deterministic_reasons"), "alignment", F.lit("pass").alias("granularity_match"), "solvability", c("parsed").alias("parse_valid"))
    rows = _REVIEW.rows(spark, sf_dir).select("doc_id", "sha", F.when(~c("missing"), review).alias("review"))
    return rows.select("doc_id", _joined(gates.review_reasons(c("review"), c("sha"))).alias("strong"), _joined(gates.independent_review_reasons(c("review"), c("sha"))).alias("independent"))


_REPOSITORY = Fields(
    has_license="doc_id % 11 <> 0",
    spdx=pick(6, "'GPL-3.0'", "'UNKNOWN'", "'BSD-3-Clause'", "'Apache-2.0'", otherwise="'MIT'"),
    has_package="doc_id % 13 <> 0",
    build_script=pick(7, "NULL", otherwise="'build'"),
    install_exit=pick(5, "1", "NULL", otherwise="0"),
    build_exit=pick(8, "2", "NULL", otherwise="0"),
    files="n_chars % 5",
    timed_out="doc_id % 9 = 0",
    error=pick(10, "'boom'", otherwise="NULL"),
)


@query(f"""WITH r AS ({_REPOSITORY.sql}) SELECT doc_id, CASE WHEN NOT has_license THEN 'LICENSE_MISSING'
  WHEN spdx NOT IN ({_quote(records.ALLOWED_LICENSES)}) THEN 'LICENSE_NOT_ALLOWED_OR_AMBIGUOUS' WHEN NOT has_package THEN 'PACKAGE_JSON_MISSING'
  WHEN build_script IS NULL THEN 'BUILD_SCRIPT_MISSING' WHEN coalesce(install_exit, 0) <> 0 THEN 'INSTALL_FAILED' WHEN coalesce(build_exit, 0) <> 0 THEN 'BUILD_FAILED'
  WHEN timed_out THEN 'TIMEOUT' WHEN error IS NOT NULL THEN 'PROCESSING_ERROR' WHEN files < 2 THEN 'INSUFFICIENT_TYPESCRIPT_GAME_CODE' END AS reason FROM r""")
def repository_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first reason against a repository for each document."""
    return _REPOSITORY.rows(spark, sf_dir).select("doc_id", gates.repository_reason(*map(F.col, _REPOSITORY.expressions)).alias("reason"))


# --- answers of models and agents --------------------------------------------------------

_CALL = Fields(
    call=pick(
        10,
        """'{"tool":"read_file","path":"' || source || '"}'""",
        """'{"tool":"read_file","path":"' || source || '","x":1}'""",
        """'{"tool":"run_command","command":"node","args":["' || lang || '"],"timeoutMs":' || (n_chars * 10) || '}'""",
        """'{"tool":"run_command","command":"node","args":["a",' || doc_id || ']}'""",
        """'{"tool":"write_file","path":"  ","content":"' || source || '"}'""",
        """'{"tool":"write_file","path":"' || source || '","content":""}'""",
        """'{"tool":"write_file","path":"' || source || '"}'""",
        """'no ' || source""",
        """'{"tool":"delete_file","path":"' || source || '"}'""",
        otherwise="""'{"tool":"run_command","command":"node","args":[],"timeoutMs":"' || doc_id || '"}'""",
    )
)


@query(f"""WITH r AS ({_CALL.sql}), j AS (SELECT doc_id, TRY_CAST(call AS JSON) AS j FROM r), k AS (SELECT *, json_keys(j) AS keys, j->>'$.tool' AS tool FROM j)
SELECT doc_id, coalesce(CASE tool WHEN 'read_file' THEN list_has_all(['tool', 'path'], keys) AND json_type(j, '$.path') = 'VARCHAR' AND trim(j->>'$.path') <> ''
  WHEN 'write_file' THEN list_has_all(['tool', 'path', 'content'], keys) AND json_type(j, '$.path') = 'VARCHAR' AND trim(j->>'$.path') <> '' AND json_type(j, '$.content') = 'VARCHAR'
  WHEN 'run_command' THEN list_has_all(['tool', 'command', 'args', 'timeoutMs'], keys) AND json_type(j, '$.command') = 'VARCHAR' AND trim(j->>'$.command') <> ''
    AND json_type(j, '$.args') = 'ARRAY' AND len(list_filter(json_type(j, '$.args[*]'), lambda t: t <> 'VARCHAR')) = 0
    AND (NOT json_exists(j, '$.timeoutMs') OR (json_type(j, '$.timeoutMs') = 'UBIGINT' AND (j->>'$.timeoutMs')::BIGINT BETWEEN 1 AND {records.MAX_TIMEOUT_MS}))
  ELSE false END, false) AS valid FROM k""")
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a tool call for each document is valid."""
    return _CALL.rows(spark, sf_dir).select("doc_id", records.valid_tool_call(F.col("call")).alias("valid"))


_PASSES = '"alignment":"PASS","granularity_match":"pass","solvability":"'
_ANSWER = Fields(
    raw=pick(
        7,
        f"""'x {{{_PASSES}' || {pick(4, "'fail'", "'Maybe'", otherwise="'pass'")} || '","reason":"' || source || '"}} y'""",
        """'"alignment": "pass", "granularity_match" : "Fail", "solvability": "PASS", "reason": "' || source""",
        """'"alignment": "pass", "granularity_match": "pass" ' || source""",
        """'{"alignment":"pass|fail","granularity_match":"pass","solvability":"pass","reason":"' || lang || '"}'""",
        """'nothing ' || source""",
        f"""'{{broken}} {_PASSES}pass" }}}}'""",
        otherwise=f"""'```json' || chr(10) || '{{{_PASSES}pass"}}' || chr(10) || '```'""",
    )
)


def _review_label(check: str) -> str:
    return f"coalesce(CASE parse_mode WHEN 'json' THEN lower(found->>'$.{check}') WHEN 'recovered_explicit_labels' THEN lower(regexp_extract(raw, '(?i)\"{check}\"\\s*:\\s*\"(pass|fail)\"', 1)) END, 'invalid') AS {check}"


_ALL_LABELS = " AND ".join(f"regexp_matches(raw, '(?i)\"{c}\"\\s*:\\s*\"(pass|fail)\"')" for c in records.CHECKS)


@query(f"""WITH r AS ({_ANSWER.sql}), f AS (SELECT *, TRY_CAST(nullif(regexp_extract(raw, '(?s)(\\{{.*\\}})', 1), '') AS JSON) AS found FROM r),
m AS (SELECT *, CASE WHEN found IS NOT NULL THEN 'json' WHEN {_ALL_LABELS} THEN 'recovered_explicit_labels' ELSE 'invalid' END AS parse_mode FROM f),
l AS (SELECT doc_id, parse_mode, CASE parse_mode WHEN 'json' THEN coalesce(found->>'$.reason', '') WHEN 'invalid' THEN '' ELSE '{records.RECOVERED}' END AS reason, {", ".join(map(_review_label, records.CHECKS))} FROM m)
SELECT *, alignment IN ('pass', 'fail') AND granularity_match IN ('pass', 'fail') AND solvability IN ('pass', 'fail') AS parse_valid FROM l""")
def review_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reviewer's answer for each document, parsed."""
    rows = _ANSWER.rows(spark, sf_dir).select("doc_id", records.parse_review(F.col("raw")).alias("r"))
    return rows.select("doc_id", "r.*")


_RESPONSE = Fields(
    body=pick(
        5,
        """'{"error":{"code":"rate_' || source || '"}}'""",
        """'{"output":[{"content":[{"type":"output_text","text":"SUCCESS: did ' || source || ' "},{"type":"refusal","text":"no"},{"type":"output_text","text":"b"}]},{"type":"x"}]}'""",
        """'{"output":[{"type":"reasoning"},{"content":[{"type":"output_text","text":"  FAILURE:' || lang || '"}]}]}'""",
        """'{"output":[{"content":[{"type":"refusal","text":"' || source || '"}]}]}'""",
        otherwise="""'{"output":[{"content":[{"type":"output_text","text":"success: ' || source || '"}]}]}'""",
    ),
    answer=pick(
        5,
        "'Sure.' || chr(10) || '```typescript' || chr(10) || text || chr(10) || '```' || chr(10) || 'Done.'",
        "'Here is it:' || chr(10) || 'const a = ' || n_chars || ';'",
        "'  ' || text || '  '",
        "'``` ' || source || ' ```'",
        otherwise="' ' || chr(10)",
    ),
)
_SPACES = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"


@query(f"""WITH r AS ({_RESPONSE.sql}), b AS (SELECT *, json_transform(body::JSON, '{{"output":[{{"content":[{{"type":"VARCHAR","text":"VARCHAR"}}]}}]}}').output AS o FROM r),
p AS (SELECT *, list_transform(list_filter(flatten(list_transform(o, lambda x: coalesce(x.content, []))), lambda x: x.type = 'output_text'), lambda x: x.text) AS parts FROM b),
t AS (SELECT doc_id, body::JSON->>'$.error.code' AS error_code, CASE WHEN len(parts) > 0 THEN array_to_string(parts, chr(10)) END AS said,
  {_SPACES.format("CASE WHEN regexp_matches(answer, '```(typescript)?[ ]*' || chr(10)) THEN string_split(string_split(answer, '```typescript' || chr(10))[2], '```')[1] ELSE answer END")} AS c FROM p),
c AS (SELECT * EXCLUDE c, CASE WHEN starts_with(c, 'Here is') THEN {_SPACES.format("c[strpos(c, chr(10)) + 1:]")} ELSE c END AS c, {_SPACES.format("said")} AS s FROM t)
SELECT doc_id, error_code, said, CASE WHEN starts_with(s, 'SUCCESS:') THEN 'success' WHEN starts_with(s, 'FAILURE:') THEN 'failure' END AS status,
  CASE WHEN starts_with(s, 'SUCCESS:') OR starts_with(s, 'FAILURE:') THEN {_SPACES.format("s[9:]")} END AS message, sha256(CASE WHEN c = '' THEN '' ELSE c || chr(10) END) AS code_digest FROM c""")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error code, text, final answer and code of a model's response for each document."""
    rows = _RESPONSE.rows(spark, sf_dir).select("doc_id", records.http_error_code(F.col("body")).alias("error_code"), records.output_text(F.col("body")).alias("said"), text.digest(code.extract_code(F.col("answer"))).alias("code_digest"))
    return rows.withColumn("f", records.final_answer(F.col("said"))).select("doc_id", "error_code", "said", "f.status", "f.message", "code_digest")


_REPAIR_SQL = "concat_ws(chr(10) || chr(10), '{continue}', 'This is evaluator-guided repair ' || (doc_id % 3 + 1) || ' of at most 3.', '{inspect}', '{leave}', '{request}', text, '{result}', '{{\"passed\":false,\"n\":' || n_chars || '}}', '{check}')".format(**chat.REPAIR)


@query(f"SELECT doc_id, sha256({_REPAIR_SQL}) AS request_digest FROM documents")
def repair_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an agent is asked after a failed evaluation, for each document as the request."""
    evaluation = F.concat(F.lit('{"passed":false,"n":'), F.col("n_chars").cast("string"), F.lit("}"))
    number = (F.col("doc_id") % 3 + 1).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", text.digest(chat.repair_request(F.col("text"), evaluation, number, F.lit(3))).alias("request_digest"))


# --- sources -----------------------------------------------------------------------------

_BODY = "'{' || chr(10) || '  // }' || chr(10) || '  const s = \"}{\" + ''{'';' || chr(10) || '  /* ' || translate(text, '*', '') || ' } */' || chr(10) || '  if (Card.of(s)) { draw(`}`); }' || chr(10) || " + pick(10, "'  // TODO' || chr(10)", otherwise="''") + " || '  return Math.max(s, Deck);' || chr(10) || '}'"
_SOURCE = Fields(
    before=pick(3, "''", "'import x;' || chr(10) || chr(10)", otherwise="'// no function here {' || chr(10)"),
    symbol=pick(4, "'play'", "'Pile'", "'run'", otherwise="'Board'") + " || doc_id",
    declaration=pick(4, "'export function play' || doc_id || '(card: Card): number '", "'class Pile' || doc_id || ' extends Deck '", "'export default async function  run' || doc_id || '(a: number)' || chr(10) || '  '", otherwise="'abstract class Board' || doc_id || ' '"),
    body=_BODY,
    after=pick(7, "chr(10) || 'function open() { \"'", "chr(10) || 'const z = (1;'", "chr(10) || '}'", "chr(10) || '/* open'", "chr(10) || '`open'", otherwise="chr(10) || 'const z = 1;'"),
)
_LINES = "(length({0}) - length(replace({0}, chr(10), '')))"
_NAMES = "regexp_extract_all(code, '[A-Za-z_$][A-Za-z0-9_$]*')"
_REFERENCED = f"list_filter({_NAMES}, lambda n: regexp_matches(n, '^[A-Z]') AND n <> symbol AND n NOT IN ({_quote(code.BUILT_IN)}))"


@query(f"""WITH r AS ({_SOURCE.sql}), u AS (SELECT *, declaration || body AS code, 1 + {_LINES.format("before")} AS start_line FROM r),
k AS (SELECT *, start_line + {_LINES.format("code")} AS end_line, {_REFERENCED} AS names FROM u WHERE length(code) BETWEEN 100 AND 3000 AND {_LINES.format("code")} BETWEEN 3 AND 99 AND NOT contains(body, 'TODO'))
SELECT doc_id, symbol, CASE WHEN contains(declaration, 'class ') THEN 'class' ELSE 'function' END AS kind, CASE WHEN contains(declaration, 'class ') THEN 'G2' ELSE 'G1' END AS granularity,
  trim(regexp_replace(declaration, '\\s+', ' ', 'g')) AS signature, sha256(code) AS code_digest, start_line, end_line, true AS declared,
  array_to_string(list_filter(names, lambda n, i: list_position(names, n) = i)[1:12], ',') AS symbols FROM k""")
def source_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code units of a source for each document, with brackets in strings and comments."""
    files = _SOURCE.rows(spark, sf_dir).select("doc_id", F.concat("before", "declaration", "body", "after").alias("text"))
    u = code.extract_units(files)
    return u.select("doc_id", "symbol", "kind", code.granularity(F.col("kind")).alias("granularity"), "signature", text.digest(F.col("code")).alias("code_digest"), "start_line", "end_line", code.symbol_declared(F.col("code"), F.col("symbol")).alias("declared"), _joined(code.referenced_symbols(F.col("code"), F.col("symbol"))).alias("symbols"))


_ERRORS = pick(7, f"'{code.OPEN_BRACKET}'", f"'{code.OPEN_BRACKET}'", f"'{code.UNBALANCED}}}'", f"'{code.OPEN_COMMENT}'", f"'{code.OPEN_STRING}'")
_LITERAL = Fields(target=pick(5, "'function roll() { return ' || n_chars || '; }'", "'function roll() { return new Map(); }'", "'function roll(a) { return 1; }'", "'export function name(): string {' || chr(10) || '  return \"' || source || '\"' || chr(10) || '}'", otherwise="'const a = 1;'"))


@query(f"""WITH r AS ({_SOURCE.sql}), t AS ({_LITERAL.sql}), b AS (SELECT doc_id, regexp_extract(target, '\\bfunction\\s+\\w+\\s*\\(\\s*\\)[^{{]*\\{{\\s*return\\s+([\\s\\S]*?)\\s*;?\\s*\\}}\\s*$', 1) AS returned FROM t)
SELECT doc_id, {_ERRORS} AS error, CASE WHEN returned <> '' AND NOT regexp_matches(returned, '[();`]|\\b(new|this|function|class|await)\\b') THEN 'eligible' ELSE 'not_eligible' END AS behaviour FROM r JOIN b USING (doc_id)""")
def source_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the delimiters of a source for each document, and whether its behaviour could be tried."""
    whole = _SOURCE.rows(spark, sf_dir).select("doc_id", code.delimiter_errors(F.concat("before", "declaration", "body", "after")).alias("error"))
    return whole.join(_LITERAL.rows(spark, sf_dir).select("doc_id", code.behaviour_check(F.col("target")).alias("behaviour")), "doc_id")


_BEHAVES = Fields(
    symbol="'roll' || doc_id % 7",
    returned=pick(
        9,
        "n_chars || ''",
        "'\"' || translate(substring(text, 1, 40), chr(34) || chr(92) || chr(10), '   ') || '\"'",
        "'[ ' || n_chars || ', true,  [null, -' || doc_id || '.5], \"' || lang || '\" ]'",
        "'{\"n\": ' || n_chars || ', \"in\": {\"lang\" : \"' || lang || '\"}}'",
        "'new Map()'",
        "chr(39) || source || chr(39)",
        "'[' || doc_id || ', ' || n_chars || ',]'",
        "'limit + 1'",
        otherwise="'false'",
    ),
    head=pick(5, "'export function '", "'export async function '", "'export default function '", otherwise="'function '"),
    annotation=pick(4, "': unknown '", otherwise="' '"),
    tail=pick(11, "' '", otherwise="'; } '"),
)


@query(f"""WITH r AS ({_BEHAVES.sql}), p AS (SELECT *, tail <> ' ' AS sound, CASE WHEN json_valid(returned) THEN CAST(json(returned) AS VARCHAR) WHEN starts_with(returned, chr(39)) THEN replace(returned, chr(39), chr(34)) WHEN ends_with(returned, ',]') THEN replace(replace(returned, ',]', ']'), ' ', '') END AS value FROM r),
b AS (SELECT *, CASE WHEN NOT sound OR value IS NULL THEN 'not_eligible' WHEN annotation <> ' ' OR contains(head, 'default') OR contains(head, 'async') THEN 'fail' ELSE 'pass' END AS behavior FROM p)
SELECT doc_id, CASE WHEN sound THEN 'pass' ELSE 'fail' END AS syntax, behavior, CASE WHEN behavior = 'pass' THEN value END AS expected_json,
  CASE WHEN NOT sound THEN 'syntax: {code.OPEN_BRACKET}' WHEN behavior = 'fail' THEN '{curation.HARNESS}' || CASE WHEN annotation <> ' ' OR contains(head, 'default') THEN 'the runtime doesn''t read the declaration' ELSE 'a promise, not the value' END ELSE '' END AS reasons FROM b""")
def target_behavior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation of a function for each document: structure, and the value it returns as JSON."""
    target = F.concat("head", "symbol", F.lit("()"), "annotation", F.lit("{\n  return "), "returned", "tail")
    units = _BEHAVES.rows(spark, sf_dir).select(F.col("doc_id").alias("unit_id"), F.lit("").alias("target_sha256"), target.alias("target"), "symbol")
    return curation.validate_targets(units).select(F.col("unit_id").alias("doc_id"), "syntax", "behavior", F.col("behavior_test.expected_json").alias("expected_json"), F.array_join("reasons", "; ").alias("reasons"))


_NAMED = Fields(
    scripts=pick(6, "array('test', 'compile', 'build:prod')", "array('rebuild', 'build:dev', 'dev')", "array('test', 'start')", "array()", otherwise="array('bundle', 'build')"),
    files=pick(5, "array('COPYING', 'LICENSE.md', 'src')", "array('README.md')", "array('license')", "array('LICENCE', 'LICENSE.txt')", otherwise="array('LICENSE', 'COPYING')"),
    path=pick(8, "'src/' || source", "'../' || source", "'a/../' || source", "'/' || source", "'C:' || source", "''", "'a..b/' || source", otherwise="'a' || chr(92) || '..' || chr(92) || source"),
)


def _first_of(order: list[str], have: str) -> str:
    return f"list_filter([{_quote(order)}], lambda x: list_contains({have}, x))[1]"


@query(f"""WITH r AS ({_NAMED.sql}) SELECT doc_id, {_first_of(records.LICENSE_FILES, "files")} AS license_file,
  coalesce({_first_of(records.BUILD_SCRIPTS, "scripts")}, list_min(list_filter(scripts, lambda s: contains(s, 'build') AND s NOT IN ({_quote(records.OTHER_SCRIPTS)})))) AS script,
  path <> '' AND NOT regexp_matches(path, '^(/|\\\\|[A-Za-z]:)') AND NOT regexp_matches(path, '(^|[/\\\\])\\.\\.([/\\\\]|$)') AS inside FROM r""")
def repository_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence file, build script and workspace guard over names for each document."""
    scripts = F.map_from_arrays(F.col("scripts").cast("array<string>"), F.transform("scripts", lambda s: F.lit("tsc")))
    return _NAMED.rows(spark, sf_dir).select("doc_id", records.first_license_file(F.col("files")).alias("license_file"), records.choose_build_script(scripts).alias("script"), records.inside_workspace(F.col("path")).alias("inside"))


_RAISED = "CASE WHEN i = 1 THEN p WHEN regexp_matches(p, '^[a-z]') THEN upper(p[1]) || p[2:] ELSE '-' || p END"
_ONE_LINE = "regexp_replace(replace(text, lang, '[REDACTED]'), '\\s+', ' ', 'g')"


@query(f"""WITH s AS (SELECT *, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), '-') AS parts FROM documents)
SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z_$][a-z0-9_$]*|\\p{{Nd}}+'))) AS n_any_case, sha256(array_to_string(list_transform(parts, lambda p, i: {_RAISED}), '')) AS camel_digest,
  {_ONE_LINE}[1:200] AS redacted, sha256(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) AS portable, text[1:40] AS head, round_even(n_chars / 7, 4) AS rounded FROM s""")
def name_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Camel case, redaction, portable digests and rounding over documents."""
    t = F.col("text")
    crlf = F.concat(F.lit("\r\n"), F.replace(t, F.lit("\n"), F.lit("\r\n")), F.lit("\r\n"))
    rounded = text.round_half_even(F.col("n_chars") / 7)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens_any_case(t)).alias("n_any_case"), text.digest(text.to_camel(text.slug(t))).alias("camel_digest"), text.redact(t, F.col("lang"), 200).alias("redacted"), text.portable_digest(crlf).alias("portable"), text.head(t, 40).alias("head"), rounded.alias("rounded"))


# --- rows --------------------------------------------------------------------------------


@query("SELECT doc_id, quality AS earlier_quality, toxic AS earlier_toxic FROM documents LEFT JOIN labels USING (doc_id)")
def carried_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the columns of an earlier run."""
    return joins.carry(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", earlier_quality="quality", earlier_toxic="toxic")


@query(f"""SELECT 'u' || doc_id AS unit_id, 't' || doc_id AS target_sha256, '{gates.STRONG_REVIEW}' AS review_version, 'm' AS reviewer, CASE WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS decision,
  CASE WHEN quality = 0 THEN 'behavior' END AS failed_check, text[1:1000] AS reason, CASE WHEN toxic = 1 THEN 'SOURCE_LEAKAGE_LANGUAGE' ELSE '' END AS said FROM documents JOIN labels USING (doc_id)""")
def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review rows from labels, with texts as reasons."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    said = gates.reasons(("SOURCE_LEAKAGE_LANGUAGE", F.col("toxic") == 1))
    decision, failed = F.when(F.col("quality") == 1, "pass").otherwise("fail"), F.when(F.col("quality") == 0, "behavior")
    rows = docs.select(*rows_of.review_row(F.concat(F.lit("u"), "doc_id"), F.concat(F.lit("t"), "doc_id"), "m", decision, failed, F.col("text"), said))
    return rows.withColumn("said", _joined(F.col("deterministic_reasons"))).drop("deterministic_reasons")


@query("""SELECT '1.0' AS audit_version, 's' || doc_id AS sample_id, lang AS category, source AS repository_family_id, 'task ' || doc_id AS instruction, sha256(text) AS code_digest,
  'pending' AS decision, 'pending' AS obvious_quality, '' AS notes FROM documents""")
def pending_audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit rows of a sample for each document."""
    c = F.col
    metadata = F.struct(c("lang").alias("category"), F.lit("G1").alias("granularity"), c("source").alias("repository_family_id"), c("source").alias("source_repo"), F.lit("src/a.ts").alias("source_path"))
    messages = rows_of.chat_messages(F.concat(F.lit("task "), "doc_id"), c("text"))
    rows = rows_of.pending_audit(table(spark, sf_dir, "documents").select(F.concat(F.lit("s"), "doc_id").alias("sample_id"), metadata.alias("metadata"), messages.alias("messages")))
    return rows.select("audit_version", "sample_id", "category", "repository_family_id", "instruction", text.digest(c("code")).alias("code_digest"), "review.decision", "review.obvious_quality", "review.notes")


@query("SELECT source AS name FROM documents UNION SELECT lang FROM documents UNION SELECT role FROM conversations")
def name_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union and distinct over three columns."""
    docs, turns = table(spark, sf_dir, "documents"), table(spark, sf_dir, "conversations")
    return docs.select(F.col("source").alias("name")).unionByName(docs.select(F.col("lang").alias("name"))).unionByName(turns.select(F.col("role").alias("name"))).distinct()


_SAMPLE = Fields(
    known=pick(9, "NULL", "'c2'", otherwise="'c1'"),
    granularity=pick(7, "'G3'", otherwise="'G1'"),
    role=pick(5, "'user'", otherwise="'assistant'"),
    text="text",
    shown=pick(6, "text || 'x'", otherwise="text"),
    solvability=pick(8, "'fail'", "NULL", otherwise="'pass'"),
    status=pick(4, "'accepted'", otherwise="'rejected'"),
    why=pick(3, "''", "NULL", otherwise="'[\"INSTRUCTION_LENGTH\"]'"),
)


@query(f"""WITH r AS ({_SAMPLE.sql}), c AS (SELECT count(*) FILTER (known IS NULL) AS a, count(*) FILTER (known IS DISTINCT FROM 'c1') AS b, count(*) FILTER (granularity = 'G3') AS c, count(*) FILTER (role = 'user' OR trim(shown) = '') AS d,
  count(*) FILTER (shown <> text) AS e, count(*) FILTER (solvability IS DISTINCT FROM 'pass') AS f, count(*) FILTER (status = 'accepted') AS g, count(*) FILTER (why IS NULL OR why = '') AS h FROM r),
n AS (SELECT unnest(['known repository', 'commit', 'granularity', 'messages', 'target digest']) AS "check", unnest([a, b, c, d, e]) AS n, a, f, g, h FROM c)
SELECT * FROM (SELECT true AS accepted, "check", n FROM n UNION ALL SELECT false, "check", n FROM n UNION ALL SELECT true, 'solvability', f FROM c UNION ALL SELECT false, 'status', g FROM c UNION ALL SELECT false, 'reasons', h FROM c) WHERE n > 0""")
def sample_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrity checks of accepted and rejected samples that a sample for each document breaks."""
    c = F.col
    one = F.struct(F.lit("user").alias("role"), F.lit("task").alias("content"))
    messages = F.array(one, F.struct("role", c("shown").alias("content")))
    quality = F.struct(F.lit("pass").alias("alignment"), F.lit("pass").alias("granularity_match"), "solvability")
    metadata = F.struct(F.lit("c1").alias("source_commit"), "granularity", quality.alias("quality"), "status", c("why").alias("rejection_reasons"))
    rows = _SAMPLE.rows(spark, sf_dir).select(c("known").alias("commit_sha"), messages.alias("messages"), F.struct(text.portable_digest(c("text")).alias("content_sha256")).alias("target"), metadata.alias("metadata"))
    found = [gates.violations(rows, *integrity.sample_checks(accepted)).select(F.lit(accepted).alias("accepted"), "check", "n") for accepted in (True, False)]
    return found[0].unionByName(found[1])


_EVALUATION = Fields(
    passed="doc_id % 2 = 0",
    build_pass=pick(3, "true", "false", otherwise="NULL"),
    functional_pass=pick(5, "false", otherwise="true"),
    files_valid=pick(7, "false", otherwise="true"),
    build_artifact_matches=pick(4, "false", otherwise="true"),
    logic_passed=pick(11, "false", otherwise="true"),
    ui_passed=pick(5, "false", otherwise="true"),
    launch_passed=pick(13, "false", otherwise="true"),
    visual_passed=pick(8, "false", otherwise="true"),
)


@query(f"""WITH r AS ({_EVALUATION.sql}) SELECT doc_id, passed, coalesce(build_pass, files_valid AND build_artifact_matches) AS build_pass,
  CASE WHEN build_pass IS NULL THEN logic_passed AND ui_passed AND launch_passed ELSE functional_pass END AS functional_pass, CASE WHEN build_pass IS NULL THEN visual_passed END AS visual_pass FROM r""")
def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluations of both shapes, one for each document, brought into one."""
    rows = _EVALUATION.rows(spark, sf_dir).select("doc_id", F.struct(*_EVALUATION.expressions).alias("e"))
    return rows.select("doc_id", metrics.normalized_evaluation(F.col("e")).alias("n")).select("doc_id", "n.*")


_GROUPS, _KEPT = 3, 9


def _seen_sql() -> str:
    """One CTE for each group in order, as each depends on those before."""
    rows = f"u AS (SELECT doc_id, doc_id % {_GROUPS} AS g, lang || (n_chars % 40) AS d, n_chars FROM documents)"
    steps, before = [rows], "SELECT NULL AS d WHERE false"
    for g in range(_GROUPS):
        steps.append(f"k{g} AS (SELECT * FROM u WHERE g = {g} AND d NOT IN (SELECT d FROM ({before})) ORDER BY n_chars DESC, doc_id LIMIT {_KEPT})")
        before += f" UNION ALL SELECT d FROM k{g}"
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f"SELECT doc_id, g, d FROM k{g}" for g in range(_GROUPS))


@query(_seen_sql())
def first_seen_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents worked through in order with one set of seen digests; a top few of each group."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % _GROUPS).alias("g"), F.concat("lang", (F.col("n_chars") % 40).cast("string")).alias("d"), "n_chars")
    return ordering.first_seen_across(docs, "g", "d", _KEPT, F.col("n_chars").desc(), F.col("doc_id")).select("doc_id", "g", "d")


# --- files -------------------------------------------------------------------------------


def _written(rows: DataFrame, name: str) -> str:
    """A new folder of JSON lines in the shared folder."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    sinks.write_jsonl(sinks.in_input_order(rows, "doc_id"), path)
    return path


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS seq, lang, CASE WHEN n_chars % 2 = 0 THEN source END AS source, sha256(text) AS digest FROM documents")
def jsonl_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines in order, read strictly and numbered by place."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("n_chars") % 2 == 0, F.col("source")).alias("source"), "text")
    back = jsonl.with_seq(jsonl.read_jsonl(spark, _written(rows, "records"), "doc_id long, lang string, source string, text string"))
    return back.select("doc_id", "seq", "lang", "source", text.digest(F.col("text")).alias("digest"))


_CHAT = Fields(
    sample_id=pick(11, "NULL", "''", "'same'", otherwise="'s' || doc_id"),
    asker=pick(7, "'system'", otherwise="'user'"),
    question=pick(5, "' '", otherwise="source"),
    answer="text",
    extra="doc_id % 13 = 0",
    gate=pick(9, "'fail'", "NULL", otherwise="'pass'"),
)


@query(f"""WITH r AS ({_CHAT.sql}), f AS (SELECT *, sample_id IS NOT NULL AND row_number() OVER (PARTITION BY sample_id ORDER BY doc_id) > 1 AS again FROM r)
SELECT sha256(answer) AS digest, coalesce(sample_id, '') AS sample_id, CASE WHEN coalesce(sample_id, '') = '' THEN 'no id' WHEN again THEN 'id seen before' WHEN extra THEN 'not one question and one answer' WHEN asker <> 'user' THEN 'not from user in place 0'
  WHEN trim(question) = '' THEN 'no text from user' WHEN trim(answer) = '' THEN 'no text from assistant' WHEN gate IS DISTINCT FROM 'pass' THEN 'solvability not passed' END AS error FROM f""")
def chat_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chat sample for each document, written as JSON lines and read by the validating loader."""
    c = F.col
    turn = lambda role, content: F.struct(role.alias("role"), content.alias("content"))
    pair = [turn(c("asker"), c("question")), turn(F.lit("assistant"), c("answer"))]
    messages = F.when(c("extra"), F.array(pair[0], pair[1], pair[0])).otherwise(F.array(*pair))
    quality = F.struct(F.lit("pass").alias("alignment"), F.lit("pass").alias("granularity_match"), c("gate").alias("solvability"))
    rows = _CHAT.rows(spark, sf_dir).select("doc_id", "sample_id", messages.alias("messages"), F.struct(quality.alias("quality")).alias("metadata"))
    read = jsonl.read_chat_samples(jsonl.read_lines(spark, _written(rows, "chats")))
    return read.select(text.digest(F.get("messages", F.lit(1))["content"]).alias("digest"), F.coalesce("sample_id", F.lit("")).alias("sample_id"), F.regexp_extract("error", r"^.*:\d+: (.*)$", 1).alias("error")).withColumn("error", F.nullif("error", F.lit("")))


# --- runs and requests -------------------------------------------------------------------

_OUTPUTS = """SELECT CAST(event_id // 7 AS VARCHAR) AS run_id, event_id % 7 + 1 AS iteration, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'final' ELSE 'tool_calls' END AS kind,
  CASE WHEN event_type IN ('view', 'click', 'signup') THEN CAST(floor(value) AS BIGINT) % 11 END AS calls, CASE WHEN user_id % 2 = 0 THEN 'success' ELSE 'failure' END AS status, CASE WHEN user_id % 3 = 0 THEN NULL ELSE props END AS message FROM events"""


@query(f"""WITH o AS ({_OUTPUTS}), e AS (SELECT run_id, min(iteration) FILTER (kind <> 'tool_calls' AND iteration <= {runs.ITERATIONS}) AS stop, max(iteration) AS seen FROM o GROUP BY run_id),
r AS (SELECT run_id, coalesce(stop, least(seen, {runs.ITERATIONS})) AS iterations, stop, seen FROM e),
b AS (SELECT o.*, coalesce(calls, 0) NOT BETWEEN 1 AND {runs.CALLS} AS refused FROM o JOIN r USING (run_id) WHERE kind = 'tool_calls' AND iteration <= iterations),
c AS (SELECT run_id, sum(CASE WHEN refused THEN 0 ELSE calls END) AS executed, count(*) FILTER (refused) AS refused, min(iteration) FILTER (refused) AS first, arg_min(coalesce(calls, 0), iteration) FILTER (refused) AS n FROM b GROUP BY run_id)
SELECT run_id, CASE WHEN kind = 'error' THEN 'failure' WHEN kind = 'final' THEN status WHEN seen >= {runs.ITERATIONS} THEN 'max_iterations' ELSE 'running' END AS status,
  CASE WHEN kind = 'error' THEN coalesce('{runs.MODEL_ERROR}' || message, 'model error') WHEN kind = 'final' THEN message WHEN seen >= {runs.ITERATIONS} THEN '{runs.STOPPED % runs.ITERATIONS}' END AS message,
  CAST(iterations AS INT) AS iterations, CAST(coalesce(executed, 0) AS BIGINT) AS executed_calls, coalesce(refused, 0) AS refused_batches, CAST(first AS INT) AS first_refused,
  CASE WHEN n = 0 THEN '{runs.EMPTY}' WHEN n IS NOT NULL THEN 'model returned ' || n || ' tool calls; limit is {runs.CALLS} per iteration' END AS refusal
FROM r LEFT JOIN c USING (run_id) LEFT JOIN o ON o.run_id = r.run_id AND o.iteration = r.stop""")
def agent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of runs of seven events each, with errors, final answers and batches of calls."""
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "final").otherwise("tool_calls")
    calls = F.when(F.col("event_type").isin("view", "click", "signup"), F.floor("value") % 11).cast("int")
    outputs = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 7).cast("string").alias("run_id"), (F.col("event_id") % 7 + 1).cast("int").alias("iteration"), kind.alias("kind"), calls.alias("calls"), F.when(F.col("user_id") % 2 == 0, "success").otherwise("failure").alias("status"), F.when(F.col("user_id") % 3 != 0, F.col("props")).alias("message"))
    return runs.outcomes(outputs)


#: Seconds an answer may take here.
_WITHIN = 400


@query(f"""WITH q AS (SELECT event_id // 4 AS id, min(ts) AS asked FROM events WHERE event_type IN ('click', 'view') GROUP BY 1), a AS (SELECT event_id // 4 AS id, ts AS told FROM events WHERE event_type IN ('purchase', 'signup')),
j AS (SELECT coalesce(q.id, a.id) AS id, asked, told, coalesce(told >= asked AND told <= asked + INTERVAL {_WITHIN} SECOND, false) AS good FROM q FULL JOIN a ON q.id = a.id),
g AS (SELECT id, bool_or(asked IS NOT NULL) AS known, min(told) FILTER (good) AS answered_at, count(*) FILTER (good) AS on_time, count(*) FILTER (told > asked + INTERVAL {_WITHIN} SECOND) AS late, count(*) FILTER (told < asked) AS early FROM j GROUP BY id)
SELECT id, CASE WHEN NOT known THEN 'unknown' WHEN on_time = 1 THEN 'answered' WHEN on_time > 1 THEN 'repeated' WHEN late > 0 THEN 'late' ELSE 'missing' END AS outcome, CAST(epoch_us(answered_at) AS BIGINT) AS answered_us, on_time, late, early FROM g""")
def request_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of requests: answered, repeated, late, missing, or answers that nobody asked for."""
    events = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 4).alias("id"), F.col("ts").alias("at"), "event_type")
    found = correlate.outcomes(events.where(F.col("event_type").isin("click", "view")), events.where(F.col("event_type").isin("purchase", "signup")), _WITHIN)
    return found.withColumn("answered_us", F.unix_micros(F.col("answered_at").cast("timestamp"))).select("id", "outcome", "answered_us", "on_time", "late", "early")


# --- merged records, tokenized conversations -----------------------------------------------


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE upper(lang) END AS lang, source AS place_source, CASE WHEN doc_id % 3 = 0 THEN n_chars ELSE -n_chars END AS place_n, CASE WHEN doc_id % 5 <> 0 THEN CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'x' END END AS place_note,
  CASE WHEN doc_id % 5 = 0 THEN NULL ELSE length(text) END AS size FROM documents""")
def merged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three records for each document merged: nested keys one by one, the later one wins, missing ones change nothing."""
    first = F.struct("doc_id", "lang", F.struct("source", F.col("n_chars").cast("long").alias("n")).alias("place"))
    second = F.when(F.col("doc_id") % 3 != 0, F.struct(F.upper("lang").alias("lang"), F.struct((-F.col("n_chars")).cast("long").alias("n"), F.lit("x").alias("note")).alias("place")))
    third = F.struct(F.when(F.col("doc_id") % 5 != 0, F.length("text")).alias("size"))
    out = merge.merge_columns(table(spark, sf_dir, "documents").select(first.alias("a"), second.alias("b"), third.alias("c")), "a", "b", "c")
    note = F.when(F.col("doc_id") % 5 != 0, F.col("place.note"))
    return out.select("doc_id", "lang", F.col("place.source").alias("place_source"), F.col("place.n").alias("place_n"), note.alias("place_note"), F.col("size").cast("long").alias("size"))


def _byte_bpe():
    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks have a core each
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own.no_truncation()
    own.no_padding()
    return lambda texts: [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


@query()
def token_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as tokens of a public vocabulary, with labels over what follows the prompt."""
    samples = chat.tokenized_samples(chat.messages_of(table(spark, sf_dir, "conversations")), _byte_bpe, "byte_bpe_50k", 512)
    return samples.select("conv_id", F.size("input_ids").alias("n_ids"), F.size(F.filter("labels", lambda x: x != chat.IGNORED)).alias("n_labels"), text.digest(F.array_join("input_ids", ",")).alias("ids_digest"), "error")
