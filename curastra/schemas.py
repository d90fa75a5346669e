"""Explicit schemas of the records. Readers never infer: versions of a record differ in types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CANDIDATE = "repo string, category string"
UNIT = (
    "schema_version string, unit_id string, repository string, repository_family_id string, category string, commit string, license string, "
    "source_path string, source_lines string, symbol string, kind string, granularity string, signature string, provided_symbols array<string>, "
    "relevance_score bigint, target_sha256 string, target string"
)
SCOPE = "struct<target_file:string,target_symbol:string,expected_behavior:array<string>,constraints:array<string>,required_context:array<string>>"
GENERATION = "struct<pipeline_version:string,model:string,method:string,decode:string,max_output_tokens:bigint,response_completed:boolean,response_id:string,status:string,duration_seconds:double>"
INSTRUCTION = f"{UNIT}, scope {SCOPE}, instruction string, generation {GENERATION}"
VALIDATION = "unit_id string, target_sha256 string, validator string, syntax string, symbol string, behavior string, reasons array<string>, behavior_test struct<kind:string,expected_json:string>"
REVIEW = "unit_id string, target_sha256 string, review_version string, reviewer string, decision string, failed_check string, reason string, deterministic_reasons array<string>"
REVIEW_V1 = "sample_id string, target_sha256 string, reviewer string, review_type string, alignment string, granularity_match string, solvability string, reason string, parse_valid boolean, parse_mode string, raw_output string, duration_seconds double"
MESSAGES = "array<struct<role:string,content:string>>"
SPEC = "sample_id string, source_repo string, checkout string, source_path string, start_line bigint, end_line bigint, granularity string, mechanisms array<string>, instruction string, provided_symbols array<string>"
MANIFEST = (
    "schema_version string, repository_id string, url string, commit_sha string, category string, "
    "license struct<spdx_id:string,file:string,file_sha256:string,verified:boolean>, "
    "build struct<node_version:string,install_command:string,build_command:string,status:string,exit_code:bigint,attempts:bigint,duration_seconds:double,warning:string>, "
    "duplicate struct<is_fork:boolean,family_id:string,exact_duplicate:boolean>"
)
SAMPLE_V1 = (
    f"schema_version string, sample_id string, messages {MESSAGES}, instruction string, context struct<language:string,provided_symbols:array<string>>, target struct<format:string,content_sha256:string>, "
    "metadata struct<source_repo:string,source_commit:string,source_path:string,source_lines:string,repository_family_id:string,license:string,granularity:string,mechanisms:array<string>,build_status:string,duplicate_status:string,"
    "quality:struct<alignment:string,granularity_match:string,solvability:string,review_method:string>,status:string,rejection_reasons:string>"
)
TASK_RESULT = (
    "task_id string, category string, difficulty string, family_id string, success boolean, first_pass_success boolean, build_pass boolean, functional_pass boolean, visual_pass boolean, "
    "repair_attempted boolean, repair_success boolean, repairs_used bigint, agent_iterations bigint, tool_calls bigint, failed_tool_calls bigint"
)


def normalized_reasons(reasons: Column) -> Column:
    """Reject reasons as array<struct<code,detail>>, from a JSON string of either version."""
    structs = F.from_json(reasons, "array<struct<code:string,detail:string>>")
    plain = F.transform(F.from_json(reasons, "array<string>"), lambda c: F.struct(c.alias("code"), F.lit(None).cast("string").alias("detail")))
    is_plain = F.get_json_object(reasons, "$[0].code").isNull()
    return F.when(reasons.isNull(), F.lit(None)).when(is_plain, plain).otherwise(structs)


def empty(spark, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
