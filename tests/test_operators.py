import hashlib
import random

import pytest
from pyspark.sql import functions as F

from curastra.functions import text
from curastra.operators import chat, components, freeze, gates, joins, metrics, ordering, records, similarity
from curastra.plans import curation

WORDS = "It moves the active card from the hand to the discard pile and returns how many cards are left in the hand so that a caller can show the number next to the deck while the round goes on and the player waits for the next turn".split()
GOOD = {
    "instruction": "In src/a.ts write playCard so that it moves the card and keeps the hand order. " + " ".join(WORDS) + ".",
    "source_path": "src/a.ts",
    "symbol": "playCard",
    "granularity": "G1",
    "provided_symbols": ["Card"],
    "target_sha256": "t",
    "scope": ("src/a.ts", "playCard", ["moves the card"], ["keeps the hand order"], ["Card"]),
    "generation": ("quality-v2", True),
}
KINDS = "instruction string, source_path string, symbol string, granularity string, provided_symbols array<string>, target_sha256 string, scope struct<target_file:string,target_symbol:string,expected_behavior:array<string>,constraints:array<string>,required_context:array<string>>, generation struct<pipeline_version:string,response_completed:boolean>"
VALID = ("t", "pass", "pass", "not_eligible")


def _reasons(spark, cases):
    rows = [(i, tuple((GOOD | change).values()), v) for i, (change, v) in enumerate(cases)]
    df = spark.createDataFrame(rows, f"i int, r struct<{', '.join(k.replace(' ', ':', 1) for k in KINDS.split(', '))}>, v struct<target_sha256:string,syntax:string,symbol:string,behavior:string>")
    return [x.reasons for x in sorted(df.select("i", gates.deterministic_reasons(F.col("r"), F.col("v")).alias("reasons")).collect())]


def test_every_gate(spark):
    s = list(GOOD["scope"])

    def scope(**change):
        names = ["file", "symbol", "behavior", "constraints", "context"]
        return {"scope": tuple(change.get(n, x) for n, x in zip(names, s, strict=True))}

    text_ = GOOD["instruction"]
    cases = [
        ({}, VALID, []),
        ({"generation": ("quality-v1", True)}, VALID, ["GENERATION_INCOMPLETE"]),
        ({"generation": ("quality-v2", None)}, VALID, ["GENERATION_INCOMPLETE"]),
        ({"generation": None}, VALID, ["GENERATION_INCOMPLETE"]),
        ({"instruction": None, "generation": None}, None, ["GENERATION_INCOMPLETE", "INSTRUCTION_INVALID"]),
        ({"scope": None}, None, ["SCOPE_MISSING"]),
        ({"instruction": "In src/a.ts write playCard: moves the card, keeps the hand order."}, VALID, ["INSTRUCTION_LENGTH"]),
        ({"instruction": text_ + " and"}, VALID, ["INSTRUCTION_INCOMPLETE"]),
        ({"instruction": text_ + " \n"}, VALID, []),
        (scope(file="src/b.ts"), VALID, ["TARGET_FILE_SCOPE_MISMATCH"]),
        (scope(symbol="play"), VALID, ["TARGET_SYMBOL_SCOPE_MISMATCH"]),
        (scope(behavior=[]), VALID, ["EXPECTED_BEHAVIOR_MISSING"]),
        (scope(behavior=["x", " "]), VALID, ["EXPECTED_BEHAVIOR_MISSING"]),
        (scope(behavior=["quantum tunnel paints violet"]), VALID, ["EXPECTED_BEHAVIOR_NOT_IN_INSTRUCTION"]),
        (scope(constraints=None), VALID, ["CONSTRAINTS_MISSING"]),
        (scope(constraints=["quantum tunnel paints violet"]), VALID, ["CONSTRAINTS_NOT_IN_INSTRUCTION"]),
        (scope(context=None), VALID, ["REQUIRED_CONTEXT_INVALID"]),
        (scope(context=[]), VALID, []),
        (scope(context=["Deck"]), VALID, ["MISSING_CONTEXT"]),
        ({"instruction": text_ + " See the Source Code."}, VALID, ["SOURCE_LEAKAGE_LANGUAGE"]),
        ({"instruction": text_ + " Meet the Specified Requirements."}, VALID, ["UNDERSPECIFIED_REFERENCE"]),
        ({"instruction": text_ + " Do it wholeheartedly."}, VALID, ["GRANULARITY_MISMATCH"]),
        (scope(behavior=["moves the card"] * 7), VALID, ["GRANULARITY_MISMATCH"]),
        ({}, None, ["TARGET_VALIDATION_MISSING"]),
        ({}, ("other", "pass", "pass", "pass"), ["TARGET_VALIDATION_MISSING"]),
        ({}, ("t", "fail", None, "fail"), ["DETERMINISTIC_BEHAVIOR_FAILED", "TARGET_SYMBOL_INVALID", "TARGET_SYNTAX_INVALID"]),
    ]
    assert _reasons(spark, [c[:2] for c in cases]) == [c[2] for c in cases]


def test_review_reasons(spark):
    kinds = "target_sha256:string,review_version:string,reviewer:string,decision:string,failed_check:string,deterministic_reasons:array<string>"
    ok = ("t", "strong-review-v2", "m", "pass", None, [])
    rows = [None, ok, ("x", *ok[1:]), ("t", "v1", *ok[2:]), ("t", "strong-review-v2", "m", "fail", "scope", []), ("t", "strong-review-v2", "m", "fail", None, None), ("t", "strong-review-v2", "m", "fail", "x", ["A", "B"]), ("t", "strong-review-v2", "deterministic-quality-v2", "pass", None, [])]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, r struct<{kinds}>")
    got = [x.x for x in sorted(df.select("i", gates.review_reasons(F.col("r"), F.lit("t")).alias("x")).collect())]
    assert got == [["STRONG_REVIEW_MISSING"], [], ["STRONG_REVIEW_INVALID"], ["STRONG_REVIEW_INVALID"], ["STRONG_REVIEW_SCOPE"], ["STRONG_REVIEW_OTHER"], ["A", "B"], ["STRONG_REVIEW_MISSING"]]


def test_require_names_broken_checks(spark):
    df = spark.range(3)
    assert gates.require(df, ("id", F.col("id") >= 0)).count() == 3
    with pytest.raises(ValueError, match=r"small \(1\)"):
        gates.require(df, ("id", F.col("id") >= 0), ("small", F.col("id") < 2))


def test_last_wins_and_joins(spark):
    left = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    right = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z")], "k string, seq int, v string")
    got = {r.k: r.e and r.e.v for r in joins.with_evidence(left, "k", e=right).collect()}
    assert got == {"a": "y", "b": None, None: None}
    with pytest.raises(KeyError, match="b"):
        joins.must_hit(left.where("k is not null"), right.select("k", "v"), "k")
    assert {r.k for r in joins.pending(left, right, "k").collect()} == {"b", None}
    with pytest.raises(ValueError, match="share k"):
        joins.require_no_leak(left, right, "k")


def _sequential(rows, near, cap):
    """Plain pass in order: what is accepted."""
    accepted, count = [], {}
    for seq, family, ok in rows:
        good = ok and not any((a, seq) in near for a in accepted) and (cap is None or count.get(family, 0) < cap)
        if good:
            accepted.append(seq)
            count[family] = count.get(family, 0) + 1
    return set(accepted)


@pytest.mark.parametrize("seed,cap", [(1, None), (2, 3), (3, 1), (4, 6)])
def test_resolve_is_a_sequential_pass(spark, seed, cap):
    r = random.Random(seed)
    n = 80
    rows = [(i, r.choice("abc"), r.random() < 0.8) for i in range(n)]
    near = {(a, b) for a in range(n) for b in range(a + 1, n) if r.random() < 0.03}
    df = spark.createDataFrame(rows, "seq long, family string, ok boolean")
    pairs = spark.createDataFrame([*near], "l long, r long")
    single = df.select("seq", F.col("seq").alias("cls"))
    got = {x.seq for x in similarity.resolve(df, [(single, pairs)], family="family", cap=cap).where("accepted").collect()}
    assert got == _sequential(rows, near, cap)


@pytest.mark.parametrize("seed,cap", [(5, None), (6, 2)])
def test_resolve_with_classes(spark, seed, cap):
    """Copies, rows without tokens and rejected firsts of a class."""
    r = random.Random(seed)
    sets = [sorted(r.sample("abcdefgh", r.choice([0, 4, 5, 6, 7, 8]))) for _ in range(90)]
    rows = [(i, r.choice("xy"), r.random() < 0.7) for i in range(90)]
    near = set()
    for j in range(90):
        for i in range(j):
            a, b = set(sets[i]), set(sets[j])
            if (len(a & b) / len(a | b) if a | b else 1.0) >= 0.8:
                near.add((i, j))
    tokens = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "seq long, tokens array<string>")
    members, distinct = similarity.classes(tokens)
    pairs = components.stored(similarity.edges(distinct, 0.8))
    df = spark.createDataFrame(rows, "seq long, family string, ok boolean")
    out = similarity.resolve(df, [(members, pairs)], family="family", cap=cap)
    accepted = {x.seq for x in out.where("accepted").collect()}
    assert accepted == _sequential(rows, near, cap)
    best = {x.seq: (x.nearest, round(x.score, 9)) for x in similarity.nearest_accepted(members, pairs, out.where("accepted"), sets=distinct).collect()}
    for j in range(90):
        scored = [(len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) if sets[i] or sets[j] else 1.0, -i) for i in accepted if i < j]
        found = [x for x in scored if x[0] > 0]
        assert best.get(j) == ((-max(found)[1], round(max(found)[0], 9)) if found else None)


def test_nearest_below_the_threshold(spark):
    r = random.Random(8)
    sets = [sorted(r.sample(range(60), r.randint(0, 12))) for _ in range(50)]
    members, distinct = similarity.classes(spark.createDataFrame([(i, list(map(str, s))) for i, s in enumerate(sets)], "seq long, tokens array<string>"))
    pairs = components.stored(similarity.edges(distinct, 0.88))
    out = similarity.resolve(spark.createDataFrame([(i, i % 3 > 0) for i in range(50)], "seq long, ok boolean"), [(members, pairs)])
    accepted = {x.seq for x in out.where("accepted").collect()}
    got = {x.seq: (x.nearest, round(x.score, 9)) for x in similarity.nearest_accepted(members, pairs, out.where("accepted"), sets=distinct).collect()}
    for j, own in enumerate(map(set, sets)):
        scored = [(len(own & set(sets[i])) / len(own | set(sets[i])) if own or sets[i] else 1.0, -i) for i in accepted if i < j]
        best = max(scored, default=(0, 0))
        assert got.get(j) == ((-best[1], round(best[0], 9)) if best[0] > 0 else None)


def test_rejected_rows_shadow_nobody(spark):
    df = spark.createDataFrame([(i, True) for i in range(3)], "seq long, ok boolean")
    chain = spark.createDataFrame([(0, 1), (1, 2)], "l long, r long")
    single = df.select("seq", F.col("seq").alias("cls"))
    assert {x.seq for x in similarity.resolve(df, [(single, chain)]).where("accepted").collect()} == {0, 2}


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.88])
def test_edges_against_all_pairs(spark, threshold):
    r = random.Random(5)
    sets = [[str(x) for x in r.sample(range(14), r.randint(0, 9))] for _ in range(60)]
    sets += [sets[3], list(reversed(sets[3])), [], []]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "seq long, tokens array<string>")
    members, distinct = similarity.classes(df)
    first = {}
    cls = {i: first.setdefault(frozenset(s), i) for i, s in enumerate(sets)}
    assert {x.seq: x.cls for x in members.collect()} == cls
    got = {(x.l, x.r): (x.shared, x.score) for x in similarity.edges(distinct, threshold).collect()}
    want = {}
    for a, i in first.items():
        for b, j in first.items():
            if i < j and a | b and len(a & b) / len(a | b) >= threshold:
                want[i, j] = (len(a & b), len(a & b) / len(a | b))
    assert got == want


def test_families_are_transitive(spark):
    files = [("b", x) for x in "12345"] + [("a", x) for x in "345678"] + [("c", x) for x in "678"] + [("z", "9")] + [("e", x) for x in "678"] + [("y", "9")]
    df = spark.createDataFrame(files, "g string, d string")
    pairs, family = similarity.families(df, "g", "d", shared=3, threshold=0.3)
    found = {(r.l, r.r, r.shared_files) for r in pairs.collect()}
    assert ("a", "b", 3) in found and ("c", "e", 3) in found and len(found) == 3  # one of c and e stands for both
    assert {r.g: r.family for r in family.collect()} == {"a": "a", "b": "a", "c": "a", "e": "a", "y": "y", "z": "z"}


def test_components_on_random_graphs(spark):
    r = random.Random(9)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 240)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "l long, r long")).collect()}
    want = {n: root(n) for n in parent}
    assert got == {n: want[n] for n in got} and all(want[n] == n for n in set(want) - set(got))
    assert components.components(spark.createDataFrame([], "l long, r long")).count() == 0


def test_round_robin(spark):

    r = random.Random(2)
    rows = [(i, r.choice("xy"), r.choice("abcd")) for i in range(70)]
    key = lambda v: hashlib.sha256(f"s:{v}".encode()).hexdigest()
    want = {}
    for stratum in "xy":
        queues = {f: sorted((i for i, s, g in rows if (s, g) == (stratum, f)), key=key) for f in sorted("abcd", key=key)}
        out = []
        while len(out) < 25 and any(queues.values()):
            out += [q.pop(0) for q in queues.values() if q]
        want[stratum] = out[:25]
    df = spark.createDataFrame(rows, "id long, s string, f string")
    got = ordering.round_robin(df, ["s"], "f", "id", 25, "s").orderBy("position").collect()
    assert {s: [x.id for x in got if x.s == s] for s in "xy"} == want
    with pytest.raises(ValueError, match="insufficient"):
        ordering.require_full(ordering.round_robin(df, ["s"], "f", "id", 60, "s"), ["s"], 60, df.select("s").distinct())
    with pytest.raises(ValueError, match="frozen sample"):
        ordering.frozen_or_new(df, 3, lambda: df)


def test_first_seen_across(spark):
    rows = [(1, 1, "p"), (1, 2, "p"), (1, 3, "q"), (2, 1, "q"), (2, 2, "p"), (2, 3, "r"), (3, 1, "r"), (3, 2, "s")]
    # group 1 keeps its first two (both p: repeats within a group survive); the cut q blocks nobody
    df = spark.createDataFrame(rows, "g long, k long, d string")
    got = {(x.g, x.k) for x in ordering.first_seen_across(df, "g", "d", 2, F.col("k")).collect()}
    assert got == {(1, 1), (1, 2), (2, 1), (2, 3), (3, 2)}


def test_metrics_have_nulls_where_nothing_counts(spark):
    kinds = "category string, difficulty string, success boolean, first_pass_success boolean, build_pass boolean, functional_pass boolean, visual_pass boolean, repair_attempted boolean, repair_success boolean, repairs_used long, agent_iterations long, tool_calls long, failed_tool_calls long"
    df = spark.createDataFrame([("a", "D1", True, False, True, True, None, False, False, 0, 3, 0, 0), ("b", "D1", False, False, True, False, None, False, False, 1, 4, 0, 0)], kinds)
    got = {(r.slice, r.value): r for r in metrics.benchmark_summary(df).collect()}
    assert got["overall", "all"].task_success_rate == 0.5 and got["overall", "all"].visual_pass_rate is None and got["overall", "all"].tool_call_failure_rate is None
    assert got["difficulty", "D3"].tasks == 0 and got["difficulty", "D3"].average_repairs_used is None and ("category", "c") not in got
    empty = {(r.slice, r.value): r.tasks for r in metrics.benchmark_summary(df.limit(0)).collect()}
    assert empty == {("overall", "all"): 0} | {("difficulty", d): 0 for d in metrics.DIFFICULTIES}


def test_evaluations_of_both_shapes(spark):
    names = ["passed", "build_pass", "functional_pass", "files_valid", "build_artifact_matches", "logic_passed", "ui_passed", "launch_passed", "visual_passed"]
    rows = [(0, (True, True, False, *[None] * 6)), (1, (False, None, None, True, True, True, False, True, True))]
    df = spark.createDataFrame(rows, "i int, e struct<" + ",".join(f"{n}:boolean" for n in names) + ">")
    got = [tuple(r.x) for r in sorted(df.select("i", metrics.normalized_evaluation(F.col("e")).alias("x")).collect())]
    assert got == [(True, True, False, None), (False, True, False, True)]


def test_masks(spark):
    df = spark.createDataFrame([(0, [1, 2], [1, 2, 3, 4]), (1, [1, 2, 3], [1, 2, 3, 4]), (2, [9], [1, 2]), (3, [1, 2], [1, 2])], "i int, p array<int>, f array<int>")
    got = {r.i: r.m for r in df.select("i", chat.masked(F.col("p"), F.col("f"), 3).alias("m")).collect()}
    assert got[0].labels == [-100, -100, 3] and got[0].attention_mask == [1, 1, 1] and got[0].error is None
    assert got[1].error.startswith("nothing") and got[2].error == "the prompt is no prefix" and got[3].error.startswith("nothing")


def test_freeze(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "id int, t string")
    one = freeze.dataset_digest(df).first()
    assert one.n == 3 and one == freeze.dataset_digest(df.orderBy(F.desc("id"))).first()
    assert one != freeze.dataset_digest(df.distinct()).first() and freeze.dataset_digest(df.limit(0)).first().n == 0
    many = spark.range(5000)
    each = sorted(hashlib.sha256(f'{{"id":{i}}}'.encode()).hexdigest() for i in range(5000))
    for width in (6, 3, 0):  # over 16 ** 3 rows, so buckets of six characters
        groups = {}
        for d, b in zip(each, [x[:width] for x in each] if width == 6 else [b[:width] for b in names], strict=True):
            groups.setdefault(b, []).append(d)
        names, each = list(groups), [hashlib.sha256("\n".join(g).encode()).hexdigest() for g in groups.values()]
    assert tuple(freeze.dataset_digest(many, per_bucket=1).first()) == (5000, each[0])
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    freeze.verify(old, old)
    with pytest.raises(ValueError, match="mismatch: audits, b"):
        freeze.verify(old, old.where("path = 'a'"), {"audits": 3}, {"audits": 4})
    settings = spark.createDataFrame([("v2", 5, True)], "name string, n int, flag boolean")
    assert [r[0] for r in freeze.failed_requirements(settings, name="v2", n=6, flag=True).collect()] == ["n"]
    samples = spark.createDataFrame([("f1", "G1", "card"), ("f1", "G2", "card"), ("f2", "G1", "tower")], "f string, g string, c string")
    audits = spark.createDataFrame([("accept",), ("reject",), ("reject",)], "d string")
    row = freeze.manifest(samples, audits, old, "m", F.col("f"), F.col("g"), F.col("c"), F.col("d")).first()
    assert (row.samples, row.families, row.reviewed, row.audit_rejected, row.granularity, row.category, row.sha256) == (3, 2, 3, 2, {"G1": 2, "G2": 1}, {"card": 2, "tower": 1}, {"a": "1", "b": "2"})
    assert freeze.same_sets(df, df) and not freeze.same_sets(df, df.distinct())


def test_audit_decisions(spark):
    audit = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "x")], "position int, sample_id string, review string")
    decisions = spark.createDataFrame([(1, "ALIGNMENT", "n"), (3, "TRUNCATED", "m")], "position int, issue string, notes string")
    got = {r.position: r.review for r in records.apply_decisions(audit, decisions).collect()}
    assert (got[1].alignment, got[1].granularity_match, got[1].decision) == ("fail", "pass", "reject")
    assert (got[2].decision, got[2].primary_issue) == ("accept", "NONE") and got[3].alignment == "not_assessable"


def test_finalize_is_a_sequential_pass(spark):
    import re

    r = random.Random(11)
    toks = lambda t: set(re.findall(r"[a-z_$][a-z0-9_$]*|\d+", t.lower()))
    units, instructions, reviews, validations = [], [], [], []
    for i in range(24):
        target = "function playCard() { return " + " + ".join(r.choice(["a", "b", "c", "d"]) * r.randint(1, 2) + str(r.randint(0, 1)) for _ in range(5)) + "; }"
        sha = f"h{i}"
        units.append((i, f"u{i:02}", "repo", r.choice("fg"), "card", "c", "MIT", "src/a.ts", "1-2", "playCard", "function", "G1", "sig", ["Card"], 3, sha, target))
        if i % 7:
            words = r.sample(WORDS, len(WORDS) - r.randint(0, 2))
            body = "In src/a.ts write playCard so that it moves the card and keeps the hand order. " + " ".join(words) + f" {r.choice(['alpha beta gamma', 'delta eps zeta'])} {i if i % 3 else ''}."
            instructions.append((f"u{i:02}", 0, body, "src/a.ts", "playCard", "G1", ["Card"], sha, GOOD["scope"], GOOD["generation"]))
        if i % 5:
            reviews.append((f"u{i:02}", 0, sha, "strong-review-v2", "m", "pass" if i % 6 else "fail", "scope", "", []))
        validations.append((f"u{i:02}", 0, sha, "pass", "pass", "pass"))
    u = spark.createDataFrame(units, "seq long, unit_id string, repository string, repository_family_id string, category string, commit string, license string, source_path string, source_lines string, symbol string, kind string, granularity string, signature string, provided_symbols array<string>, relevance_score long, target_sha256 string, target string")
    ins = spark.createDataFrame(instructions, "unit_id string, seq long, instruction string, source_path string, symbol string, granularity string, provided_symbols array<string>, target_sha256 string, scope struct<target_file:string,target_symbol:string,expected_behavior:array<string>,constraints:array<string>,required_context:array<string>>, generation struct<pipeline_version:string,response_completed:boolean>")
    rev = spark.createDataFrame(reviews, "unit_id string, seq long, target_sha256 string, review_version string, reviewer string, decision string, failed_check string, reason string, deterministic_reasons array<string>")
    val = spark.createDataFrame(validations, "unit_id string, seq long, target_sha256 string, syntax string, symbol string, behavior string")
    out = {x.sample_id: x.metadata for x in curation.finalize(u, ins, rev, val, per_family=4).collect()}
    told, asked, accepted, count = {x[0]: x[2] for x in instructions}, {x[0]: x[5] for x in reviews}, [], {}

    def near(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    for row in units:
        uid, family, target = row[1], row[3], toks(row[16])
        reasons = set() if uid in told else {"GENERATION_FAILED"}
        reasons |= {"STRONG_REVIEW_MISSING"} if uid not in asked else {"STRONG_REVIEW_SCOPE"} if asked[uid] == "fail" else set()
        mine = toks(told.get(uid, ""))
        if any(near(target, a) >= 0.88 for a, _ in accepted):
            reasons.add("TARGET_NEAR_DUPLICATE")
        if uid in told and any(near(mine, b) >= 0.92 for _, b in accepted):
            reasons.add("INSTRUCTION_NEAR_DUPLICATE")
        if count.get(family, 0) >= 4:
            reasons.add("FAMILY_SAMPLE_CAP")
        if not reasons:
            accepted.append((target, mine))
            count[family] = count.get(family, 0) + 1
        assert (out[uid].rejection_reasons or []) == sorted(reasons), uid
    assert accepted


def test_jsonl_and_streaming(spark, tmp_path):
    from curastra.sources import jsonl, sinks
    from curastra.streaming.resume import run_available

    path = tmp_path / "a.jsonl"
    good = '{"sample_id":"%s","messages":[{"role":"user","content":"q"},{"role":"assistant","content":"%s"}],"metadata":{"quality":{"alignment":"pass","granularity_match":"pass","solvability":"pass"}}}'
    path.write_text("\r\n".join([good % ("a", "x"), "", "{bad", good % ("a", "y"), good % ("b", " "), '{"sample_id":""}', good.replace('"solvability":"pass"', '"solvability":"fail"') % ("c", "z")]))
    got = {r.line: r.error and r.error.split(": ", 1)[1] for r in jsonl.read_chat_samples(jsonl.read_lines(spark, str(path))).collect()}
    assert got == {1: None, 3: "no JSON", 4: "id seen before", 5: "no text from assistant", 6: "no id", 7: "solvability not passed"}
    assert jsonl.read_jsonl_or_empty(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        jsonl.read_jsonl(spark, str(path), "sample_id string").collect()
    seqs = jsonl.with_seq(spark.range(0, 100, 1, 7)).collect()
    assert [r.id for r in sorted(seqs, key=lambda r: r.seq)] == list(range(100)) and {r.seq for r in seqs} == set(range(100))

    sinks.split_write(spark.range(5), F.col("id") < 2, str(tmp_path / "yes"), str(tmp_path / "no"))
    assert spark.read.json(str(tmp_path / "yes")).count() == 2 and spark.read.json(str(tmp_path / "no")).count() == 3

    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    source.mkdir()
    (source / "1.json").write_text('{"id":1}\n{"id":2}\n{"id":2}\n')
    work = lambda df: df.withColumn("twice", F.col("id") * 2)
    run_available(spark, str(source), "id long", work, "id", out, state)
    (source / "2.json").write_text('{"id":2}\n{"id":3}\n')
    run_available(spark, str(source), "id long", work, "id", out, state)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_source_files(spark, tmp_path):
    from curastra.sources.jsonl import keeps, typescript_files

    for name in ("build/src/a.ts", "build/src/a.d.ts", "build/node_modules/b.ts", "build/test/c.ts", "build/generated/d.ts", "build/appConfig.ts"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("x")
    root = str(tmp_path / "build")
    got = {purpose: {r.path for r in typescript_files(spark, root, purpose).collect()} for purpose in ("family", "eligible", "extract")}
    assert got == {"family": {"src/a.ts", "test/c.ts", "generated/d.ts", "appConfig.ts"}, "eligible": {"src/a.ts"}, "extract": {"src/a.ts", "test/c.ts"}}
    assert keeps is not None


def test_extraction_and_review_stages(spark):
    body = "export function playCard{n}(card) {{\n  // deck\n  const hand = deck.draw(card, {n});\n  if (hand) {{ discard(hand); }}\n  return hand.length + {n};\n}}\n"
    files = spark.createDataFrame([("o/a", "src/x.ts", body.format(n=1) + "\n" + body.format(n=2)), ("o/b", "y.ts", body.format(n=1))], "repo string, path string, text string")
    repos = spark.createDataFrame([("o/a", 0, "card", "f", "c", "MIT"), ("o/b", 1, "card", "f", "c", "MIT")], "repo string, seq long, category string, family_id string, commit string, spdx_id string")
    found = components.stored(curation.extract(repos, files))
    units = found.orderBy("unit_id").collect()
    assert [(x.unit_id, x.symbol, x.source_lines) for x in units] == [("scale-o-a-0001", "playCard1", "1-6"), ("scale-o-a-0002", "playCard2", "8-13")]
    validated = curation.validate_targets(found)
    checked = validated.collect()
    assert {(x.syntax, x.symbol, x.behavior) for x in checked} == {("pass", "pass", "not_eligible")}

    def model(frames):
        for f in frames:
            yield f[["unit_id", "target_sha256"]].assign(decision="pass", failed_check="none", reason="ok")

    ins = found.withColumn("instruction", F.lit(None).cast("string")).withColumn("scope", F.lit(None).cast("struct<target_file:string,target_symbol:string,expected_behavior:array<string>,constraints:array<string>,required_context:array<string>>")).withColumn("generation", F.lit(None).cast("struct<pipeline_version:string,response_completed:boolean>"))
    done = spark.createDataFrame([("scale-o-a-0001",)], "unit_id string")
    got = curation.review(ins, validated, done, model, "m", "unit_id string, target_sha256 string, decision string, failed_check string, reason string").collect()
    assert [(x.unit_id, x.decision, x.deterministic_reasons) for x in got] == [("scale-o-a-0002", "fail", ["GENERATION_INCOMPLETE", "INSTRUCTION_INVALID"])]
    named = curation.group_families(repos.drop("family_id"), files).collect()
    assert {x.family_id for x in named} == {"github-family:o/a", "github-family:o/b"}
    assert text is not None


def test_first_version_is_a_sequential_pass(spark):
    import re

    r = random.Random(21)
    rows, reviews = [], []
    for i in range(40):
        t = " ".join(r.sample(["a", "b", "c", "d", "e", "F", "g"], r.choice([0, 5, 6, 7]))) + r.choice(["", " ", "\n"])
        rows.append((i, f"s{i}", f"h{i}", t))
        if i % 6:
            reviews.append((f"s{i}", 1, f"h{i}" if i % 11 else "old", "pass" if i % 7 else "fail", "pass", "pass", i % 13 != 0))
    got = {x.seq: x for x in curation.finalize_first_version(spark.createDataFrame(rows, "seq long, sample_id string, content_sha256 string, target string"), spark.createDataFrame(reviews, "sample_id string, seq long, target_sha256 string, alignment string, granularity_match string, solvability string, parse_valid boolean")).collect()}
    known, hashes, accepted = {x[0]: x for x in reviews}, set(), []
    for i, sid, h, t in rows:
        v = known.get(sid)
        why = ["INDEPENDENT_REVIEW_INVALID"] if v is None or not v[6] else ["INDEPENDENT_REVIEW_TARGET_MISMATCH"] if v[2] != h else ["INDEPENDENT_REVIEW_FAILED"] if v[3] != "pass" else []
        digest, toks = hashlib.sha256(t.strip().encode()).hexdigest(), set(re.findall(r"[a-z_$][a-z0-9_$]*|\d+", t.lower()))
        scores = [len(toks & o) / len(toks | o) if toks | o else 1.0 for o in accepted]
        why += ["EXACT_DUPLICATE_TARGET"] if digest in hashes else []
        why += ["NEAR_DUPLICATE_TARGET"] if max(scores, default=0) >= 0.8 else []
        assert got[i].reasons == why, (i, t)
        assert max(scores, default=0) < 0.8 or got[i].score == round(max(scores), 4)
        if not why:
            hashes.add(digest)
            accepted.append(toks)
