"""Integrity of manifests and samples: named checks for ``gates.violations`` and ``gates.require``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import ALLOWED_LICENSES, CHECKS
from ..functions.text import portable_digest
from .gates import require
from .ordering import repeated_keys


def manifest_checks() -> list[tuple[str, Column]]:
    """Checks of a repository manifest's row."""
    return [
        ("schema version", F.col("schema_version") == "0.1"),
        ("repository id", F.col("repository_id").contains("/")),
        ("repository url", F.col("url").startswith("https://github.com/")),
        ("commit", F.col("commit_sha").rlike("^[0-9a-f]{40}$")),
        ("allowed licence", F.col("license.spdx_id").isin(*ALLOWED_LICENSES)),
        ("verified licence", F.col("license.verified")),
        ("build passed", (F.col("build.exit_code") == 0) & F.col("build.status").startswith("passed")),
        ("no fork", ~F.col("duplicate.is_fork")),
    ]


def sample_checks(accepted: bool) -> list[tuple[str, Column]]:
    """Checks of a sample's row, joined with its manifest's ``commit_sha`` (null if unknown)."""
    m = F.col("messages")
    said = lambda i, role: (F.get(m, F.lit(i))["role"] == role) & F.get(m, F.lit(i))["content"].rlike(r"(?U)\S")
    checks = [
        ("known repository", F.col("commit_sha").isNotNull()),
        ("commit", F.col("commit_sha") == F.col("metadata.source_commit")),
        ("granularity", F.col("metadata.granularity").isin("G1", "G2")),
        ("messages", (F.size(m) == 2) & said(0, "user") & said(1, "assistant")),
        ("target digest", portable_digest(F.get(m, F.lit(1))["content"]) == F.col("target.content_sha256")),
    ]
    if accepted:
        return checks + [(c, F.col(f"metadata.quality.{c}") == "pass") for c in CHECKS]
    return checks + [("status", F.col("metadata.status") == "rejected"), ("reasons", F.col("metadata.rejection_reasons").isNotNull() & ~F.col("metadata.rejection_reasons").isin("", "[]"))]


def validate(manifests: DataFrame, accepted: DataFrame, rejected: DataFrame) -> None:
    """Fails with the names of broken checks, repeated ids or repeated targets."""
    require(manifests, *manifest_checks())
    known = manifests.select(F.col("repository_id").alias("_repo"), "commit_sha")
    for samples, ok in ((accepted, True), (rejected, False)):
        require(samples.join(known, F.col("metadata.source_repo") == F.col("_repo"), "left"), *sample_checks(ok))
    every = accepted.select("sample_id", "target").unionByName(rejected.select("sample_id", "target"))
    for what, rows, key in (("repository", manifests, "repository_id"), ("sample id", every, "sample_id"), ("target", every.select("target.content_sha256"), "content_sha256")):
        again = repeated_keys(rows, key).limit(3).collect()
        if again:
            raise ValueError(f"repeated {what}: " + ", ".join(str(r[0]) for r in again))


def file_totals(files: DataFrame, key: str = "repo", length: str = "length") -> DataFrame:
    """(key, eligible_files, source_bytes) of each repository's files."""
    return files.groupBy(key).agg(F.count("*").alias("eligible_files"), F.sum(length).alias("source_bytes"))
