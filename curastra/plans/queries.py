"""Queries over the standard tables, one or more for each kind of operator, with DuckDB SQL.

``documents`` stands in for targets and instructions (``source`` is the family, ``lang`` the
category), ``labels`` for reviews, ``benchmark`` for the holdout, ``conversations`` for
chat samples, ``pages`` for source files, ``events`` for agent runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code, records, text
from ..operators import chat, components, freeze, gates, integrity, joins, metrics, ordering, similarity
from ..operators import records as rows_of
from . import curation

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TOKENS = r"list_distinct(regexp_extract_all(lower({0}), '[a-z_$][a-z0-9_$]*|\p{{Nd}}+'))"
_WORDS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}_](?:[\p{{L}}\p{{N}}_''-]*[\p{{L}}\p{{N}}_])?')"
_STRIP = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _quote(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


# --- gates -------------------------------------------------------------------------------

_LEAK = " OR ".join(f"contains(lower(text), '{p}')" for p in gates.LEAKAGE)
_GATES = f"""
  CASE WHEN len({_WORDS.format("text")}) NOT BETWEEN 45 AND 140 THEN 'INSTRUCTION_LENGTH' END,
  CASE WHEN NOT regexp_matches(text, '[.!?]\\s*$') THEN 'INSTRUCTION_INCOMPLETE' END,
  CASE WHEN {_LEAK} THEN 'SOURCE_LEAKAGE_LANGUAGE' END,
  CASE WHEN regexp_matches(text, '{gates.VAGUE}') THEN 'UNDERSPECIFIED_REFERENCE' END,
  CASE WHEN regexp_matches(text, '{gates.TOO_WIDE}') THEN 'GRANULARITY_MISMATCH' END"""


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the reasons that their texts alone give."""
    found = gates.reasons(*gates.text_gates(F.col("text")), ("GRANULARITY_MISMATCH", F.col("text").rlike(gates.TOO_WIDE)))
    return table(spark, sf_dir, "documents").withColumn("reasons", found)


@query(f"SELECT doc_id, array_to_string(list_sort(list_filter([{_GATES}], lambda r: r IS NOT NULL)), ',') AS reasons FROM documents")
def gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("doc_id", F.array_join(gates.sorted_reasons(F.col("reasons")), ",").alias("reasons"))


_HISTOGRAM = f"""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY sha256({_STRIP.format("text")}) ORDER BY doc_id) AS k FROM documents),
r AS (SELECT unnest([{_GATES}, CASE WHEN k > 1 THEN 'EXACT_DUPLICATE_TARGET' END,
  CASE WHEN quality IS NULL THEN 'STRONG_REVIEW_MISSING' WHEN quality = 0 THEN 'STRONG_REVIEW_QUALITY' END]) AS reason FROM d LEFT JOIN labels USING (doc_id))
SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason"""


@query(_HISTOGRAM)
def reason_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: text gates, exact duplicates and missing or failed reviews, counted by reason."""
    docs = _gated(spark, sf_dir).withColumn("digest", text.stripped_digest(F.col("text")))
    docs = similarity.first_of_equals(docs.select("doc_id", "digest", "reasons"), "digest", "doc_id")
    reviews = table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(0).alias("seq"))
    rows = joins.with_evidence(docs, "doc_id", review=reviews)
    more = gates.reasons(
        ("EXACT_DUPLICATE_TARGET", F.col("exact_duplicate")),
        ("STRONG_REVIEW_MISSING", F.col("review.quality").isNull()),
        ("STRONG_REVIEW_QUALITY", F.col("review.quality") == 0),
    )
    return gates.histogram(rows.select(F.concat("reasons", more).alias("reasons")))


@query("""WITH v AS (SELECT count(*) FILTER (doc_id IS NULL) AS id, count(*) FILTER (length(text) <> n_chars) AS length, count(*) FILTER (n_chars > 1000) AS short, count(*) FILTER (NOT contains(text, 'the')) AS word FROM documents)
SELECT * FROM (SELECT unnest(['id', 'length', 'short', 'word']) AS "check", unnest([id, length, short, word]) AS n FROM v) WHERE n > 0""")
def integrity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of documents that some break, with how many do; the first two hold in good data."""
    docs = table(spark, sf_dir, "documents")
    return gates.violations(docs, ("id", F.col("doc_id").isNotNull()), ("length", F.length("text") == F.col("n_chars")), ("short", F.col("n_chars") <= 1000), ("word", F.col("text").contains("the")))


# --- joins -------------------------------------------------------------------------------


@query("SELECT d.doc_id, coalesce(CASE WHEN l.doc_id % 3 = 0 THEN 1 - l.quality ELSE l.quality END, -1) AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def review_join_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    # one in three has a second, opposite review
    again = labels.where("doc_id % 3 = 0").select("doc_id", (1 - F.col("quality")).alias("quality"), F.lit(2).alias("seq"))
    reviews = labels.withColumn("seq", F.lit(1)).unionByName(again)
    return joins.with_evidence(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", review=reviews).select("doc_id", F.coalesce("review.quality", F.lit(-1)).alias("quality"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 0)")
def pending_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", F.col("toxic") == 0)


@query("SELECT DISTINCT source FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND source IN (SELECT source FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)")
def leakage_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return joins.leaked(known.where("quality = 1"), known.where("toxic = 1"), "source")


@query("SELECT l.doc_id, source, quality FROM labels l JOIN documents USING (doc_id)")
def must_hit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return joins.must_hit(table(spark, sf_dir, "labels").select("doc_id", "quality"), docs, "doc_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def foreign_key_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return joins.unmatched(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), good, "o_custkey")


@query(f"""
WITH d AS (SELECT doc_id, {_TOKENS.format("text")} AS t FROM documents), b AS (SELECT item_id, {_TOKENS.format("text")} AS t FROM benchmark)
SELECT doc_id, item_id, len(list_intersect(d.t, b.t)) / len(b.t) AS coverage FROM d, b WHERE len(list_intersect(d.t, b.t)) >= 0.8 * len(b.t) AND len(b.t) > 0""")
def benchmark_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", text.tokens(F.col("text")).alias("tokens"))
    items = table(spark, sf_dir, "benchmark").select("item_id", text.tokens(F.col("text")).alias("tokens"))
    return similarity.holdout_overlap(own, items, 0.8, "doc_id", "item_id")


# --- similarity --------------------------------------------------------------------------

_EDGES = f"""
d AS (SELECT doc_id, {_TOKENS.format("text")} AS t FROM documents),
s AS (SELECT doc_id, len(t) AS n, unnest(t) AS w FROM d),
e AS (SELECT a.doc_id AS l, b.doc_id AS r, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS score
  FROM s a JOIN s b ON a.w = b.w AND a.doc_id < b.doc_id AND least(a.n, b.n) >= 0.88 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id
  HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.88)"""


def _near(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents")
    members, sets = similarity.classes(docs.select(F.col("doc_id").alias("seq"), text.tokens(F.col("text")).alias("tokens")))
    return members, components.stored(similarity.edges(sets, 0.88))


@query(f"""WITH {_EDGES}, c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(t)) AS cls FROM d)
SELECT l, r, score FROM e WHERE l IN (SELECT cls FROM c) AND r IN (SELECT cls FROM c)""")
def near_dup_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different token sets, named by their first documents."""
    return _near(spark, sf_dir)[1].select("l", "r", "score")


@query(f"WITH {_EDGES} SELECT doc_id, min(doc_id) OVER (PARTITION BY list_sort(t)) AS cls FROM d")
def token_set_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near(spark, sf_dir)[0].select(F.col("seq").alias("doc_id"), "cls")


@query(f"""WITH RECURSIVE {_EDGES},
p AS (SELECT r AS c, list(l) AS ps, row_number() OVER (ORDER BY r) AS k FROM e GROUP BY r),
g(k, rej) AS (SELECT 0::BIGINT, CAST([] AS BIGINT[]) UNION ALL
  SELECT p.k, CASE WHEN len(list_filter(ps, lambda z: NOT list_contains(rej, z))) > 0 THEN list_append(rej, c) ELSE rej END FROM g JOIN p ON p.k = g.k + 1),
x AS (SELECT unnest(rej) AS doc_id FROM g WHERE k = (SELECT count(*) FROM p))
SELECT doc_id, doc_id NOT IN (SELECT doc_id FROM x) AS accepted FROM documents""")
def near_dup_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.lit(True).alias("ok"))
    return similarity.resolve(rows, [_near(spark, sf_dir)]).select(F.col("seq").alias("doc_id"), "accepted")


@query(f"""WITH RECURSIVE {_EDGES},
p AS (SELECT r AS c, list(l) AS ps, row_number() OVER (ORDER BY r) AS k FROM e GROUP BY r),
g(k, rej) AS (SELECT 0::BIGINT, coalesce((SELECT list(doc_id) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)), CAST([] AS BIGINT[])) UNION ALL
  SELECT p.k, CASE WHEN NOT list_contains(rej, c) AND len(list_filter(ps, lambda z: NOT list_contains(rej, z))) > 0 THEN list_append(rej, c) ELSE rej END FROM g JOIN p ON p.k = g.k + 1),
x AS (SELECT unnest(rej) AS doc_id FROM g WHERE k = (SELECT count(*) FROM p))
SELECT doc_id, doc_id NOT IN (SELECT doc_id FROM x) AS accepted FROM documents""")
def near_dup_reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pass where documents without a good label are rejected and shadow nobody."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("seq"), F.lit(True).alias("ok"))
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq")).join(good, "seq", "left")
    return similarity.resolve(rows, [_near(spark, sf_dir)]).select(F.col("seq").alias("doc_id"), "accepted")


@query(f"""
WITH g AS (SELECT doc_id, source, len(list_filter([{_GATES}], lambda r: r IS NOT NULL)) = 0 AS ok FROM documents),
k AS (SELECT doc_id, ok, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY doc_id) AS n FROM g)
SELECT doc_id, ok AND n <= 4 AS accepted FROM k""")
def family_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _gated(spark, sf_dir).select(F.col("doc_id").alias("seq"), "source", (F.size("reasons") == 0).alias("ok"))
    return similarity.resolve(rows, family="source", cap=4).select(F.col("seq").alias("doc_id"), "accepted")


@query(f"SELECT doc_id, sha256({_STRIP.format('text')}) AS digest, row_number() OVER (PARTITION BY sha256({_STRIP.format('text')}) ORDER BY doc_id) > 1 AS exact_duplicate FROM documents")
def exact_dup_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text.stripped_digest(F.col("text")).alias("digest"))
    return similarity.first_of_equals(docs, "digest", "doc_id")


_FILES = "SELECT DISTINCT source AS g, sha256(trim(line)) AS d FROM (SELECT source || '-' || (doc_id % 4) AS source, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> ''"


@query(f"""
WITH RECURSIVE f AS ({_FILES}), n AS (SELECT g, count(*) AS n FROM f GROUP BY g),
p AS (SELECT a.g AS l, b.g AS r, count(*) AS c FROM f a JOIN f b ON a.d = b.d AND a.g < b.g GROUP BY ALL HAVING count(*) >= 3),
e AS (SELECT l, r FROM p JOIN n x ON x.g = l JOIN n y ON y.g = r WHERE c / (x.n + y.n - c) >= 0.02),
u AS (SELECT l, r FROM e UNION SELECT r, l FROM e),
c(g, m) AS (SELECT g, g FROM n UNION SELECT u.r, c.m FROM c JOIN u ON u.l = c.g)
SELECT g AS source, min(m) AS family FROM c GROUP BY g""")
def family_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat_ws("-", "source", F.col("doc_id") % 4).alias("source"), F.explode(F.split("text", "\n")).alias("line"))
    lines = docs.where(F.trim("line") != "").select("source", text.digest(F.trim("line")).alias("d"))
    return similarity.families(lines, "source", "d", shared=3, threshold=0.02)[1]


# --- order -------------------------------------------------------------------------------


@query("""
WITH c AS (SELECT doc_id, lang, quality, source, sha256('audit:' || doc_id) AS k, sha256('audit:' || source) AS f FROM documents JOIN labels USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, quality, source ORDER BY k) AS turn FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY lang, quality ORDER BY turn, f) AS position FROM r)
SELECT doc_id, lang, quality, source, position FROM p WHERE position <= 8""")
def round_robin_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return ordering.round_robin(rows, ["lang", "quality"], "source", "doc_id", 8, "audit").select("doc_id", "lang", "quality", "source", "position")


_SCORE = " + ".join(f"(CASE WHEN contains(lower(text), '{w}') THEN {k} ELSE 0 END)" for ws, k in ((code.COMMON, 1), (code.SPECIFIC["card"], 2)) for w in ws)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "source", "n_chars", code.relevance(F.col("text"), F.lit("card")).alias("score"))


@query(f"SELECT * FROM (SELECT doc_id, source, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, n_chars, doc_id) AS rank FROM (SELECT *, {_SCORE} AS score FROM documents)) WHERE rank <= 5")
def topk_per_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.top_per_group(_scored(spark, sf_dir), "source", 5, F.col("score").desc(), F.col("n_chars"), F.col("doc_id")).select("doc_id", "source", "score", "rank")


@query(f"SELECT doc_id, {_SCORE} AS score FROM documents ORDER BY score DESC, doc_id LIMIT 25")
def global_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.top(_scored(spark, sf_dir).select("doc_id", "score"), 25, F.col("score").desc(), F.col("doc_id"))


@query("SELECT doc_id, 'scale-' || source || '-' || repeat('0', greatest(0, 4 - length(CAST(row_number() OVER (ORDER BY source, doc_id) AS VARCHAR)))) || row_number() OVER (ORDER BY source, doc_id) AS unit_id FROM documents")
def numbered_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ordering.numbered_ids(docs.select("doc_id", "source"), F.concat(F.lit("scale-"), "source", F.lit("-")), "source", "doc_id").select("doc_id", "unit_id")


@query("WITH p AS (SELECT event_id, row_number() OVER (ORDER BY sha256('s:1:' || event_id), event_id) AS place FROM events) SELECT event_id, place, CAST(ceil(place / 8) AS BIGINT) AS batch FROM p")
def shuffled_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.shuffled_batches(table(spark, sf_dir, "events").select("event_id"), "event_id", "s", 1, 8)


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY user_id")
def last_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value", "event_type")
    kind = F.col("event_type") == events.agg(F.min("event_type")).first()[0]
    return ordering.last_event(events, "user_id", "event_id", kind).select("user_id", "event_id", "value")


@query("SELECT sha256(text) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.repeated_keys(table(spark, sf_dir, "documents").select(text.digest(F.col("text")).alias("digest")), "digest")


# --- metrics -----------------------------------------------------------------------------

_RESULTS = """
r AS (SELECT event_id AS task_id, event_type AS category, 'D' || CAST(1 + user_id % 3 AS VARCHAR) AS difficulty, value > 20 AS success, value > 40 AS first_pass_success,
  value > 10 AS build_pass, value > 15 AS functional_pass, CASE WHEN event_id % 4 = 0 THEN value > 25 END AS visual_pass, event_id % 5 = 0 AS repair_attempted,
  event_id % 5 = 0 AND value > 20 AS repair_success, event_id % 3 AS repairs_used, 1 + event_id % 4 AS agent_iterations, event_id % 7 AS tool_calls, event_id % 2 AS failed_tool_calls,
  event_id % 11 = 0 AS reached_repair_limit, event_id % 2 AS variant FROM events)"""
_SUMMARY = """count(*) AS tasks, avg(success::INT) AS task_success_rate, avg(first_pass_success::INT) AS first_pass_success_rate, avg(build_pass::INT) AS build_pass_rate,
  avg(functional_pass::INT) AS functional_pass_rate, avg(visual_pass::INT) AS visual_pass_rate, avg(repair_success::INT) FILTER (repair_attempted) AS repair_success_rate,
  avg(repairs_used) AS average_repairs_used, avg(agent_iterations) AS average_agent_iterations, sum(failed_tool_calls) / nullif(sum(tool_calls), 0) AS tool_call_failure_rate"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v, i = table(spark, sf_dir, "events"), F.col("value"), F.col("event_id")
    return e.select(
        i.alias("task_id"), F.col("event_type").alias("category"), F.concat(F.lit("D"), (1 + F.col("user_id") % 3).cast("string")).alias("difficulty"),
        (v > 20).alias("success"), (v > 40).alias("first_pass_success"), (v > 10).alias("build_pass"), (v > 15).alias("functional_pass"), F.when(i % 4 == 0, v > 25).alias("visual_pass"),
        (i % 5 == 0).alias("repair_attempted"), ((i % 5 == 0) & (v > 20)).alias("repair_success"), (i % 3).alias("repairs_used"), (1 + i % 4).alias("agent_iterations"),
        (i % 7).alias("tool_calls"), (i % 2).alias("failed_tool_calls"), (i % 11 == 0).alias("reached_repair_limit"), (i % 2).alias("variant"),
    )


@query(f"""WITH {_RESULTS}, s AS (SELECT 'overall' AS slice, 'all' AS value, {_SUMMARY} FROM r UNION ALL SELECT 'category', category, {_SUMMARY} FROM r GROUP BY category
  UNION ALL SELECT 'difficulty', difficulty, {_SUMMARY} FROM r GROUP BY difficulty)
SELECT * FROM s UNION ALL SELECT 'difficulty', d, 0, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM (VALUES ('D1'), ('D2'), ('D3'), ('D4')) t(d) WHERE d NOT IN (SELECT difficulty FROM r)""")
def metrics_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.benchmark_summary(_results(spark, sf_dir))


@query(f"""WITH {_RESULTS} SELECT variant, count(*) AS tasks, count(*) FILTER (success) AS task_success, count(*) FILTER (build_pass) AS build_pass, count(*) FILTER (functional_pass) AS functional_pass,
  count(*) FILTER (first_pass_success) AS first_pass_success, sum(repairs_used) AS total_repairs_used, count(*) FILTER (reached_repair_limit) AS repair_limit_reached FROM r GROUP BY variant""")
def variant_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.variant_summary(_results(spark, sf_dir))


_ATTEMPTS = "a AS (SELECT user_id AS task_id, event_id AS attempt, event_id % 6 AS iterations, value > 30 AS passed, value > 10 AS build_pass, value > 20 AS functional_pass, CASE WHEN user_id % 2 = 0 THEN value > 25 END AS visual_pass FROM events WHERE event_id % 3 = 0)"


@query(f"""WITH {_ATTEMPTS}, t AS (SELECT user_id AS task_id, count(*) AS n, count(*) FILTER (value <= 30) AS bad FROM events WHERE event_id % 3 = 1 GROUP BY 1),
w AS (SELECT task_id, arg_max(a, attempt) AS z, arg_min(a, attempt) AS f, count(*) AS n, sum(iterations) AS agent_iterations FROM a GROUP BY task_id)
SELECT w.task_id, z.passed AS success, f.passed AS first_pass_success, z.build_pass AS build_pass, z.functional_pass AS functional_pass, coalesce(CAST(z.visual_pass AS VARCHAR), 'none') AS visual_pass, w.n > 1 AS repair_attempted,
  NOT f.passed AND z.passed AS repair_success, w.n - 1 AS repairs_used, agent_iterations, coalesce(t.n, 0) AS tool_calls, coalesce(t.bad, 0) AS failed_tool_calls FROM w LEFT JOIN t USING (task_id)""")
def task_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = table(spark, sf_dir, "events"), F.col("value")
    attempts = e.where("event_id % 3 = 0").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("attempt"), (F.col("event_id") % 6).alias("iterations"), (v > 30).alias("passed"), (v > 10).alias("build_pass"), (v > 20).alias("functional_pass"), F.when(F.col("user_id") % 2 == 0, v > 25).alias("visual_pass"))
    # the events between attempts are calls and their results; the roll-up itself counts results
    kind = F.when(F.col("event_id") % 3 == 1, "tool_result").otherwise("tool_call")
    called = e.where("event_id % 3 <> 0").select(F.col("user_id").alias("task_id"), kind.alias("type"), (v > 30).alias("ok"))
    return metrics.task_rollup(attempts, called).withColumn("visual_pass", F.coalesce(F.col("visual_pass").cast("string"), F.lit("none")))


@query("SELECT user_id AS task_id, event_id % 2 AS attempt, string_agg(event_type, ',' ORDER BY event_id) AS tools FROM events GROUP BY ALL")
def tools_by_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    calls = e.select(F.col("user_id").alias("task_id"), (F.col("event_id") % 2).alias("attempt"), F.col("event_id").alias("seq"), F.lit("tool_call").alias("type"), F.col("event_type").alias("tool"))
    return metrics.tools_by_attempt(calls).withColumn("tools", F.array_join("tools", ","))


@query("SELECT event_type AS epoch, avg(value) AS mean, arg_min(value, event_id) AS first, arg_max(value, event_id) AS last FROM events GROUP BY 1")
def training_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.training_curve(table(spark, sf_dir, "events").select(F.col("event_type").alias("epoch"), F.col("event_id").alias("step"), F.col("value").alias("loss")))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 1")
def shortest_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.shortest(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id")


@query("SELECT count(*) AS units, count(*) FILTER (quality = 1) AS accepted, count(*) FILTER (quality IS DISTINCT FROM 1) AS rejected, count(DISTINCT source) FILTER (quality = 1) AS families FROM documents LEFT JOIN labels USING (doc_id)")
def funnel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return metrics.funnel(rows.select(F.col("source").alias("family"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("accepted")))


@query("SELECT source, count(l.doc_id) AS n FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1 AND quality = 0) l USING (doc_id) GROUP BY source")
def counts_with_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    bad = docs.join(table(spark, sf_dir, "labels").where("toxic = 1 and quality = 0"), "doc_id")
    return metrics.counts_with_zero(docs, bad, "source")


# --- chat --------------------------------------------------------------------------------


@query("SELECT conv_id, count(*) = 2 AND count(*) FILTER (turn = 0 AND role = 'user' AND regexp_matches(text, '\\S')) = 1 AND count(*) FILTER (turn = 1 AND role = 'assistant' AND regexp_matches(text, '\\S')) = 1 AS valid FROM conversations GROUP BY conv_id")
def chat_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.is_pair(table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS rendered FROM conversations GROUP BY conv_id")
def chat_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.messages_of(table(spark, sf_dir, "conversations")).select("conv_id", chat.render(F.col("messages")).alias("rendered"))


@query("""WITH c AS (SELECT conv_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn, role, text) AS whole,
  arg_min('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), turn) || '<|im_start|>assistant' || chr(10) AS prompt FROM conversations GROUP BY conv_id),
n AS (SELECT conv_id, least(length(whole), 512) AS n, length(prompt) AS p, starts_with(whole, prompt) AS ok FROM c)
SELECT conv_id, n AS n_ids, greatest(n - p, 0) AS n_labels, CASE WHEN NOT ok THEN 'the prompt is no prefix' WHEN n <= p THEN 'nothing of the response is left' END AS error FROM n""")
def response_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a rendered message has 24 characters at least, so 22 of them decide the first 512; one more may be empty
    rows = chat.messages_of(table(spark, sf_dir, "conversations"), first=23)
    prompt = chat.code_points(chat.render(F.slice("messages", 1, 1), opened=True))
    m = chat.masked(prompt, chat.code_points(chat.render(F.col("messages"))), 512)
    rows = rows.select("conv_id", m.alias("m"))
    return rows.select("conv_id", F.size("m.input_ids").alias("n_ids"), F.size(F.filter("m.labels", lambda x: x != -100)).alias("n_labels"), "m.error")


# --- text, code, records -----------------------------------------------------------------


@query(r"""SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z_$][a-z0-9_$]*|\p{Nd}+'))) AS n_tokens,
  sha256(trim(regexp_replace(regexp_replace(text, '//.*|/\*(.|\n)*?\*/', '', 'g'), '\s+', ' ', 'g'))) AS code_digest,
  regexp_replace(regexp_replace(lower(text[1:80]), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, sha256('seed:' || doc_id) AS stable_key,
  right(text, 100) AS tail, least(pow(2, doc_id % 6), 8) AS backoff FROM documents""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(t)).alias("n_tokens"), text.digest(text.normalize_code(t)).alias("code_digest"), text.slug(text.head(t, 80)).alias("slug"), text.stable_key("seed", F.col("doc_id")).alias("stable_key"), text.tail(t, 100).alias("tail"), text.backoff_seconds(F.col("doc_id") % 6).alias("backoff"))


_CONTENT = f"list_filter({_TOKENS.format('text')}, lambda w: w NOT IN ({_quote(text.STOP_WORDS)}))"


@query(f"""WITH a AS (SELECT doc_id, {_CONTENT} AS t FROM documents), p AS (SELECT x.doc_id, x.t AS e, y.t AS t FROM a x JOIN a y ON y.doc_id = x.doc_id + 1)
SELECT doc_id, CASE WHEN len(e) = 0 THEN 0.0 ELSE len(list_intersect(e, t)) / len(e) END AS coverage FROM p""")
def coverage_of_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next"))
    return docs.join(after, "doc_id").select("doc_id", text.coverage(F.array("text"), F.col("next")).alias("coverage"))


@query(r"""WITH t AS (SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN contains(t, 'apache license') AND contains(t, 'version 2.0') THEN 'Apache-2.0'
  WHEN contains(t, 'redistribution and use in source and binary forms') THEN CASE WHEN contains(t, 'neither the name') OR contains(t, 'names of its contributors') THEN 'BSD-3-Clause' ELSE 'BSD-2-Clause' END
  WHEN contains(t, 'permission is hereby granted, free of charge') AND contains(t, 'the software is provided "as is"') THEN 'MIT' ELSE 'UNKNOWN' END AS spdx FROM t""")
def license_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", records.detect_license(F.col("text")).alias("spdx"))


@query("""SELECT doc_id, CASE WHEN doc_id % 10 + 2 <= len(l) THEN array_to_string(l[doc_id % 10 + 1:doc_id % 10 + 2], chr(10)) END AS lines
FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM documents)""")
def line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("doc_id") % 10 + 1
    return table(spark, sf_dir, "documents").select("doc_id", text.line_slice(F.col("text"), start, start + 1).alias("lines"))


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each script of a page; one with a null text for a page without any."""
    scripts = F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", "url", F.explode_outer(scripts).alias("text"))


@query()
def delimiter_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scripts(spark, sf_dir).select("page_id", code.delimiter_errors("text").alias("error"))


@query()
def code_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code.extract_units(_scripts(spark, sf_dir).select("page_id", "text"))


@query("SELECT regexp_extract(url, '://([^/?#]*)', 1) AS repo, count(*) AS eligible_files, sum(length(html))::BIGINT AS source_bytes FROM pages GROUP BY 1")
def file_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("repo"), F.length("html").alias("length"))
    return integrity.file_totals(pages)


@query("""SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN 'fail' WHEN doc_id % 5 = 3 THEN 'not_assessable' ELSE 'pass' END AS alignment,
  CASE WHEN doc_id % 5 = 2 THEN 'fail' WHEN doc_id % 5 = 3 THEN 'not_assessable' ELSE 'pass' END AS granularity_match,
  CASE WHEN doc_id % 5 IN (1, 2, 3) THEN 'reject' ELSE 'accept' END AS decision FROM documents""")
def audit_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit("").alias("review"))
    kind = F.when(F.col("doc_id") % 5 == 1, "ALIGNMENT").when(F.col("doc_id") % 5 == 2, "GRANULARITY_OR_SOLVABILITY").when(F.col("doc_id") % 5 == 3, "TRUNCATED")
    told = docs.select("doc_id", kind.alias("issue"), F.lit("n").alias("notes")).where("issue is not null")
    return rows_of.apply_decisions(docs, told, "doc_id").select("doc_id", "review.alignment", "review.granularity_match", "review.decision")


@query("SELECT doc_id, list_sort(list_distinct([CASE WHEN contains(text, chr(10)) THEN 'LINES' END, CASE WHEN n_chars > 1000 THEN 'LONG' END]))[1] AS first_reason FROM documents")
def first_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gates.sorted_reasons(gates.reasons(("LINES", F.col("text").contains("\n")), ("LONG", F.col("n_chars") > 1000)))
    return table(spark, sf_dir, "documents").select("doc_id", F.get(found, F.lit(0)).alias("first_reason"))


# --- releases, whole pipeline ------------------------------------------------------------


@query("""WITH e AS (SELECT sha256(to_json({doc_id: doc_id, lang: lang, n_chars: n_chars, source: source})) AS d FROM documents),
p AS (SELECT d[1:3] AS b, count(*) AS n, sha256(string_agg(d, chr(10) ORDER BY d)) AS d FROM e GROUP BY 1)
SELECT sum(n)::BIGINT AS n, sha256(string_agg(d, chr(10) ORDER BY b)) AS digest FROM p""")
def dataset_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freeze.dataset_digest(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"))


@query("SELECT 'doc-' || doc_id AS what FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT 'samples'")
def freeze_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc-"), "doc_id").alias("path"), text.digest(F.col("text")).alias("sha256"))
    now = docs.select("path", F.when(F.col("doc_id") % 7 == 0, "changed").otherwise(F.col("sha256")).alias("sha256"))
    return freeze.mismatches(docs.select("path", "sha256"), now, {"samples": 3, "audits": 2}, {"samples": 4, "audits": 2})


def _chunks(name: str, source: str) -> str:
    """CTEs with (path, chunk, sha256) of each 256 bytes of a text, as ``name``."""
    return f"""{name}_h AS (SELECT doc_id::VARCHAR AS path, hex(encode(coalesce(text, ''))) AS h FROM {source}),
{name}_r AS (SELECT path, h, unnest(range(greatest(CAST(ceil(len(h) / 512) AS BIGINT), 1))) AS chunk FROM {name}_h),
{name} AS (SELECT path, chunk, sha256(unhex(substring(h, chunk * 512 + 1, 512))) AS sha256 FROM {name}_r)"""


@query(f"""WITH RECURSIVE {_chunks("c", "documents")},
t(path, n, m, i, d) AS (SELECT path, count(*) OVER (PARTITION BY path), count(*) OVER (PARTITION BY path), chunk, sha256 FROM c
  UNION ALL SELECT path, n, (m + 3) // 4, i // 4, sha256(string_agg(d, chr(10) ORDER BY i)) FROM t WHERE m > 1 GROUP BY path, n, m, i // 4)
SELECT path, n AS n_chunks, d AS root FROM t WHERE m = 1""")
def text_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freeze.tree_digests(freeze.text_chunks(table(spark, sf_dir, "documents"), "doc_id", "text", 256), 4)


@query(f"""WITH edited AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 3),
{_chunks("a", "documents")}, {_chunks("b", "edited")}
SELECT path, chunk, CASE WHEN b.sha256 IS NULL THEN 'missing' WHEN a.sha256 IS NULL THEN 'added' ELSE 'changed' END AS what
FROM a FULL JOIN b USING (path, chunk) WHERE a.sha256 IS DISTINCT FROM b.sha256""")
def changed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    edited = docs.where("doc_id % 11 <> 3").withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return freeze.changed_chunks(*(freeze.text_chunks(d, "doc_id", "text", 256) for d in (docs, edited)))


_TOLD = "'In src/a.ts write play so that it moves every card. ' || text || '.'"
_CODE = r"trim(regexp_replace(regexp_replace(text, '//.*|/\*(.|\n)*?\*/', '', 'g'), '\s+', ' ', 'g'))"


def _alike(name: str, tokens: str, threshold: float) -> str:
    """CTEs with the pairs (l, r) of documents whose ``tokens`` reach the threshold, as ``name``."""
    return f"""{name}_s AS (SELECT doc_id, len(t) AS n, unnest(t) AS w FROM (SELECT doc_id, {_TOKENS.format(tokens)} AS t FROM documents)),
{name} AS (SELECT a.doc_id AS l, b.doc_id AS r FROM {name}_s a JOIN {name}_s b ON a.w = b.w AND a.doc_id < b.doc_id AND least(a.n, b.n) >= {threshold} * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING count(*) >= {threshold} * (any_value(a.n) + any_value(b.n) - count(*)))"""


@query(f"""WITH RECURSIVE {_alike("target", _CODE, curation.TARGET_NEAR)}, {_alike("told", _TOLD, curation.INSTRUCTION_NEAR)},
i AS (SELECT doc_id, source, quality, {_TOLD} AS text FROM documents LEFT JOIN labels USING (doc_id)),
j AS (SELECT doc_id, source, list_filter([{_GATES}, CASE WHEN quality IS NULL THEN 'STRONG_REVIEW_MISSING' WHEN quality = 0 THEN 'STRONG_REVIEW_BEHAVIOR' END], lambda r: r IS NOT NULL) AS why FROM i),
p AS (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) AS k, coalesce((SELECT list(l) FROM target WHERE r = doc_id), []) || coalesce((SELECT list(l) FROM told WHERE r = doc_id), []) AS near FROM j WHERE len(why) = 0),
g(k, kept, held) AS (SELECT 0::BIGINT, CAST([] AS BIGINT[]), CAST([] AS VARCHAR[]) UNION ALL
  SELECT p.k, CASE WHEN free THEN list_append(kept, doc_id) ELSE kept END, CASE WHEN free THEN list_append(held, source) ELSE held END
  FROM (SELECT p.*, g.kept, g.held, len(list_intersect(g.kept, p.near)) = 0 AND len(list_filter(g.held, lambda f: f = p.source)) < {curation.PER_FAMILY} AS free FROM g JOIN p ON p.k = g.k + 1) p),
x AS (SELECT doc_id, source FROM (SELECT unnest(kept) AS doc_id, unnest(held) AS source FROM g WHERE k = (SELECT count(*) FROM p))),
y AS (SELECT doc_id, list_sort(list_distinct(list_filter(why || [
  CASE WHEN doc_id IN (SELECT r FROM target WHERE l IN (SELECT doc_id FROM x)) THEN 'TARGET_NEAR_DUPLICATE' END, CASE WHEN doc_id IN (SELECT r FROM told WHERE l IN (SELECT doc_id FROM x)) THEN 'INSTRUCTION_NEAR_DUPLICATE' END,
  CASE WHEN (SELECT count(*) FROM x WHERE x.source = j.source AND x.doc_id < j.doc_id) >= {curation.PER_FAMILY} THEN 'FAMILY_SAMPLE_CAP' END], lambda r: r IS NOT NULL))) AS why FROM j)
SELECT 'u' || doc_id AS sample_id, CASE WHEN len(why) = 0 THEN 'accepted' ELSE 'rejected' END AS status, array_to_string(why, ',') AS reasons FROM y""")
def curated_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage over documents as units, with the labels as reviews."""
    docs = table(spark, sf_dir, "documents")
    sha = text.stripped_digest(F.col("text"))
    units = docs.select(
        F.col("doc_id").alias("seq"), F.concat(F.lit("u"), "doc_id").alias("unit_id"), F.col("source").alias("repository"), F.col("source").alias("repository_family_id"), F.col("lang").alias("category"),
        F.lit("c").alias("commit"), F.lit("MIT").alias("license"), F.lit("src/a.ts").alias("source_path"), F.lit("1-9").alias("source_lines"), F.lit("play").alias("symbol"), F.lit("function").alias("kind"),
        F.lit("G1").alias("granularity"), F.lit("function play()").alias("signature"), F.array(F.lit("Card")).alias("provided_symbols"), F.lit(3).cast("long").alias("relevance_score"), sha.alias("target_sha256"), F.col("text").alias("target"),
    )
    scope = F.struct(F.lit("src/a.ts").alias("target_file"), F.lit("play").alias("target_symbol"), F.array(F.lit("moves every card")).alias("expected_behavior"), F.array(F.lit("write play")).alias("constraints"), F.array(F.lit("Card")).alias("required_context"))
    generation = F.struct(F.lit(gates.PIPELINE).alias("pipeline_version"), F.lit(True).alias("response_completed"))
    instructions = units.withColumns({"instruction": F.concat(F.lit("In src/a.ts write play so that it moves every card. "), F.col("target"), F.lit(".")), "scope": scope, "generation": generation})
    labelled = docs.select("doc_id", sha.alias("target_sha256")).join(table(spark, sf_dir, "labels").where("quality is not null"), "doc_id")  # no text is shuffled for it
    reviews = labelled.select(F.concat(F.lit("u"), "doc_id").alias("unit_id"), F.lit(0).alias("seq"), "target_sha256", F.lit(gates.STRONG_REVIEW).alias("review_version"), F.lit("m").alias("reviewer"), F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("decision"), F.lit("behavior").alias("failed_check"), F.lit("").alias("reason"), F.array().cast("array<string>").alias("deterministic_reasons"))
    validations = units.select("unit_id", "seq", "target_sha256", F.lit("pass").alias("syntax"), F.lit("pass").alias("symbol"), F.lit("pass").alias("behavior"))
    out = curation.finalize(units, instructions, reviews, validations)
    return out.select("sample_id", F.col("metadata.status").alias("status"), F.array_join(F.coalesce("metadata.rejection_reasons", F.array().cast("array<string>")), ",").alias("reasons"))


@query(f"""WITH RECURSIVE s AS (SELECT doc_id, len(t) AS n, unnest(t) AS w FROM (SELECT doc_id, {_TOKENS.format("text")} AS t FROM documents)),
e AS (SELECT a.doc_id AS l, b.doc_id AS r, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS score FROM s a JOIN s b ON a.w = b.w AND a.doc_id < b.doc_id AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*))),
d AS (SELECT doc_id, sha256({_STRIP.format("text")}) AS digest, CASE WHEN quality IS NULL THEN 'INDEPENDENT_REVIEW_INVALID' WHEN doc_id % 10 = 0 THEN 'INDEPENDENT_REVIEW_TARGET_MISMATCH' WHEN quality = 0 OR toxic = 1 THEN 'INDEPENDENT_REVIEW_FAILED' END AS said FROM documents LEFT JOIN labels USING (doc_id)),
p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k, coalesce((SELECT list(l) FROM e WHERE r = doc_id), []) AS near FROM d WHERE said IS NULL),
g(k, kept) AS (SELECT 0::BIGINT, CAST([] AS BIGINT[]) UNION ALL SELECT p.k, CASE WHEN len(list_intersect(kept, near)) = 0 THEN list_append(kept, doc_id) ELSE kept END FROM g JOIN p ON p.k = g.k + 1),
x AS (SELECT unnest(kept) AS doc_id FROM g WHERE k = (SELECT count(*) FROM p)),
y AS (SELECT a.doc_id AS l, b.doc_id AS r, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS score FROM s a JOIN s b ON a.w = b.w AND a.doc_id < b.doc_id WHERE a.doc_id IN (SELECT doc_id FROM x) GROUP BY a.doc_id, b.doc_id),
n AS (SELECT r AS doc_id, first(l ORDER BY score DESC, l) AS nearest, max(score) AS score FROM y GROUP BY r)
SELECT doc_id, coalesce(array_to_string([said, CASE WHEN EXISTS (SELECT 1 FROM x JOIN d o USING (doc_id) WHERE o.digest = d.digest AND o.doc_id < d.doc_id) THEN 'EXACT_DUPLICATE_TARGET' END, CASE WHEN score >= 0.8 THEN 'NEAR_DUPLICATE_TARGET' END], ','), '') AS reasons,
  nearest, round_even(coalesce(score, 0), 4) AS score FROM d LEFT JOIN n USING (doc_id)""")
def first_version_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of the first record version over documents, with labels as reviews, and the nearest accepted rows."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    name, sha = F.concat(F.lit("u"), "doc_id").alias("sample_id"), text.digest(F.col("text"))
    passed = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "pass").otherwise("fail")
    candidates = docs.select(F.col("doc_id").alias("seq"), name, sha.alias("content_sha256"), F.col("text").alias("target"))
    reviews = docs.where("quality is not null").select(name, F.lit(0).alias("seq"), F.when(F.col("doc_id") % 10 == 0, "stale").otherwise(sha).alias("target_sha256"), F.lit(True).alias("parse_valid"), *(passed.alias(c) for c in records.CHECKS))
    out = curation.finalize_first_version(candidates, reviews)
    return out.select(F.col("seq").alias("doc_id"), F.array_join("reasons", ",").alias("reasons"), "nearest", "score")
