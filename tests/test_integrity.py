import hashlib

import pytest
from pyspark.sql import functions as F

from curastra import schemas
from curastra.operators import integrity, records


def _tables(spark):
    m = ("0.1", "o/a", "https://github.com/o/a", "a" * 40, "card", ("MIT", "LICENSE", "x", True), ("22", "i", "b", "passed", 0, 1, 1.0, None), (False, "f", False))
    manifests = spark.createDataFrame([m], schemas.MANIFEST)

    def sample(i, code, status, quality, reasons):
        sha = hashlib.sha256(code.replace("\r\n", "\n").strip().encode()).hexdigest()
        meta = ("o/a", "a" * 40, "p", "1-2", "f", "MIT", "G1", [], "passed", "unique", (quality, quality, quality, "m"), status, reasons)
        return ("0.1", i, [("user", "do it"), ("assistant", code)], "do it", ("TypeScript", []), ("code_unit", sha), meta)

    good = spark.createDataFrame([sample("s1", "let a;\r\n", "accepted", "pass", None)], schemas.SAMPLE_V1)
    bad = spark.createDataFrame([sample("s2", "let b;", "rejected", "fail", '[{"code":"X","detail":"y"}]')], schemas.SAMPLE_V1)
    return manifests, good, bad


def test_sound_tables_pass(spark):
    integrity.validate(*_tables(spark))


@pytest.mark.parametrize("change,message", [("commit", "commit"), ("twice", "repeated sample id"), ("digest", "target digest"), ("quality", "alignment")])
def test_broken_tables_fail(spark, change, message):
    manifests, good, bad = _tables(spark)
    if change == "commit":
        manifests = manifests.withColumn("commit_sha", F.lit("b" * 40))
    elif change == "twice":
        bad = bad.withColumn("sample_id", F.lit("s1"))
    elif change == "digest":
        good = good.withColumn("target", F.struct(F.lit("code_unit").alias("format"), F.lit("0").alias("content_sha256")))
    else:
        good = good.withColumn("metadata", F.col("metadata").withField("quality.alignment", F.lit("fail")))
    with pytest.raises(ValueError, match=message):
        integrity.validate(manifests, good, bad)


def test_reasons_of_both_versions(spark):
    df = spark.createDataFrame([(0, '[{"code":"X","detail":"y"}]'), (1, '["A","B"]'), (2, None), (3, "[]")], "i int, r string")
    got = [[tuple(x) for x in r.x] if r.x is not None else None for r in sorted(df.select("i", schemas.normalized_reasons(F.col("r")).alias("x")).collect())]
    assert got == [[("X", "y")], [("A", None), ("B", None)], None, []]


def test_sliced_samples(spark):
    manifests, _, _ = _tables(spark)
    spec = ("s9", "o/a", "o__a", "x.ts", 2, 3, "G1", ["m"], "do", ["Card"])
    specs = spark.createDataFrame([spec], schemas.SPEC)
    files = spark.createDataFrame([("o__a", "x.ts", "one\ntwo\n  three\n")], "checkout string, path string, text string")
    row = records.sliced_samples(specs, manifests, files).first()
    assert row.messages[1].content == "two\n  three\n" and row.metadata.source_lines == "2-3" and row.metadata.repository_family_id == "f"
    assert row.target.content_sha256 == hashlib.sha256(b"two\n  three").hexdigest()
    with pytest.raises(Exception, match="line range outside file: s9"):
        records.sliced_samples(specs.withColumn("end_line", F.lit(4).cast("long")), manifests, files).collect()
    with pytest.raises(KeyError, match="o/b"):
        records.sliced_samples(specs.withColumn("source_repo", F.lit("o/b")), manifests, files)


def test_file_totals(spark):
    df = spark.createDataFrame([("a", 3), ("a", 4), ("b", 1)], "repo string, length long")
    assert {tuple(r) for r in integrity.file_totals(df).collect()} == {("a", 2, 7), ("b", 1, 1)}
