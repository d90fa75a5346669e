"""Roll-ups of agent runs and training logs. Rates are null where nothing could count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Difficulties, which are reported even if they have no task.
DIFFICULTIES = ["D1", "D2", "D3", "D4"]


def rate(counts: Column, of: Column | None = None) -> Column:
    """Share of rows (or of those that ``of`` selects) for which ``counts`` holds."""
    if of is None:
        return F.try_divide(F.count_if(counts), F.count("*"))
    return F.try_divide(F.count_if(counts & of), F.count_if(of))


def summary_columns() -> list[Column]:
    """The metrics of a set of task results."""
    col = F.col
    return [
        F.count("*").alias("tasks"),
        rate(col("success")).alias("task_success_rate"),
        rate(col("first_pass_success")).alias("first_pass_success_rate"),
        rate(col("build_pass")).alias("build_pass_rate"),
        rate(col("functional_pass")).alias("functional_pass_rate"),
        rate(col("visual_pass"), col("visual_pass").isNotNull()).alias("visual_pass_rate"),
        rate(col("repair_success"), col("repair_attempted")).alias("repair_success_rate"),
        F.avg("repairs_used").alias("average_repairs_used"),
        F.avg("agent_iterations").alias("average_agent_iterations"),
        F.try_divide(F.sum("failed_tool_calls"), F.sum("tool_calls")).alias("tool_call_failure_rate"),
    ]


def benchmark_summary(results: DataFrame, difficulties: list[str] | None = None) -> DataFrame:
    """The metrics over all tasks, by category and by difficulty: (slice, value, ...).

    Categories are those present; every difficulty has a row. One pass over the results
    expands each row three times before the partial aggregate.
    """
    spark = results.sparkSession
    slices = F.array(F.struct(F.lit("overall").alias("slice"), F.lit("all").alias("value")), F.struct(F.lit("category").alias("slice"), F.col("category").alias("value")), F.struct(F.lit("difficulty").alias("slice"), F.col("difficulty").alias("value")))
    rows = results.withColumn("_s", F.explode(slices)).select("*", "_s.slice", "_s.value").drop("_s")
    summary = rows.where("value is not null").groupBy("slice", "value").agg(*summary_columns())
    domain = spark.createDataFrame([("overall", "all")] + [("difficulty", d) for d in difficulties or DIFFICULTIES], "slice string, value string")
    missing = domain.join(summary, ["slice", "value"], "left_anti")
    empty = [F.lit(0).cast("long").alias(c) if c == "tasks" else F.lit(None).cast(summary.schema[c].dataType).alias(c) for c in summary.columns[2:]]
    return summary.unionByName(missing.select("slice", "value", *empty))


def variant_summary(results: DataFrame, variant: str = "variant") -> DataFrame:
    """Counters of each model variant."""
    return results.groupBy(variant).agg(
        F.count("*").alias("tasks"),
        F.count_if("success").alias("task_success"),
        F.count_if("build_pass").alias("build_pass"),
        F.count_if("functional_pass").alias("functional_pass"),
        F.count_if("first_pass_success").alias("first_pass_success"),
        F.sum("repairs_used").alias("total_repairs_used"),
        F.count_if("reached_repair_limit").alias("repair_limit_reached"),
    )


def normalized_evaluation(e: Column) -> Column:
    """struct(passed, build_pass, functional_pass, visual_pass) of either shape of evaluation.

    A single-file evaluation has ``build_pass`` and no visual verdict; a project's has files,
    build, logic, UI, launch and visual ones.
    """
    simple = e["build_pass"].isNotNull()
    project = lambda *names: _all(*(e[n] for n in names))
    return F.struct(
        e["passed"].alias("passed"),
        F.when(simple, e["build_pass"]).otherwise(project("files_valid", "build_artifact_matches")).alias("build_pass"),
        F.when(simple, e["functional_pass"]).otherwise(project("logic_passed", "ui_passed", "launch_passed")).alias("functional_pass"),
        F.when(simple, F.lit(None)).otherwise(e["visual_passed"]).alias("visual_pass"),
    )


def _all(first: Column, *others: Column) -> Column:
    for o in others:
        first = first & o
    return first


def task_rollup(attempts: DataFrame, events: DataFrame) -> DataFrame:
    """A row for each task from its attempts (task_id, attempt, iterations, evaluation fields) and events.

    ``attempts`` has ``passed``, ``build_pass``, ``functional_pass``, ``visual_pass``; the
    first attempt gives the first pass, the last one the outcome. ``events`` has ``type``
    and ``ok``.
    """
    called = events.where(F.col("type") == "tool_result").groupBy("task_id").agg(F.count("*").alias("tool_calls"), F.count_if(~F.col("ok")).alias("failed_tool_calls"))
    verdict = F.struct("passed", "build_pass", "functional_pass", "visual_pass")
    runs = attempts.groupBy("task_id").agg(F.max_by(verdict, "attempt").alias("last"), F.min_by(verdict, "attempt").alias("first"), F.count("*").alias("n"), F.sum("iterations").alias("agent_iterations"))
    return runs.join(called, "task_id", "left").select(
        "task_id",
        F.col("last.passed").alias("success"),
        F.col("first.passed").alias("first_pass_success"),
        *(F.col(f"last.{c}").alias(c) for c in ("build_pass", "functional_pass", "visual_pass")),
        (F.col("n") > 1).alias("repair_attempted"),
        (~F.col("first.passed") & F.col("last.passed")).alias("repair_success"),
        (F.col("n") - 1).alias("repairs_used"),
        "agent_iterations",
        F.coalesce("tool_calls", F.lit(0)).alias("tool_calls"),
        F.coalesce("failed_tool_calls", F.lit(0)).alias("failed_tool_calls"),
    )


def tools_by_attempt(events: DataFrame) -> DataFrame:
    """(task_id, attempt, tools): names of the called tools in order; runs are short."""
    calls = events.where(F.col("type") == "tool_call").groupBy("task_id", "attempt").agg(F.array_sort(F.collect_list(F.struct("seq", "tool"))).alias("c"))
    return calls.select("task_id", "attempt", F.transform("c", lambda c: c["tool"]).alias("tools"))


def training_curve(steps: DataFrame, epoch: str = "epoch", step: str = "step", loss: str = "loss") -> DataFrame:
    """(epoch, mean, first, last) of the losses."""
    return steps.groupBy(epoch).agg(F.avg(loss).alias("mean"), F.min_by(loss, step).alias("first"), F.max_by(loss, step).alias("last"))


def shortest(rows: DataFrame, length: str, seq: str) -> DataFrame:
    """The first of the shortest rows."""
    return rows.agg(F.min_by(F.struct(*rows.columns), F.struct(length, seq)).alias("m")).select("m.*")


def counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def counts_with_zero(groups: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """(key, n) for every group, also those without rows."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"))
    return groups.select(key).distinct().join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def funnel(decisions: DataFrame, accepted: str = "accepted", family: str = "family") -> DataFrame:
    """One row: units, accepted, rejected, families with an accepted unit."""
    return decisions.agg(F.count("*").alias("units"), F.count_if(accepted).alias("accepted"), F.count_if(~F.col(accepted)).alias("rejected"), F.countDistinct(F.when(F.col(accepted), F.col(family))).alias("families"))
