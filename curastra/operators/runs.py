"""What became of agent runs, told by the models' outputs: bounded iteration as data.

A run goes through its outputs in order of ``iteration`` (from 1). An error or a final answer
ends it; a batch of calls that is empty or over the limit is refused as a whole and the run goes
on; after ``most`` iterations it is over. Outputs after the end count for nothing. In batch
that is two aggregates of a run's rows; ``streaming.runs`` folds the same as outputs come in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Iterations of a run and calls of a batch at most; what is said of a refused batch.
ITERATIONS, CALLS = 6, 8
EMPTY, TOO_MANY = "model returned an empty tool call batch", "model returned %d tool calls; limit is %d per iteration"
#: What is said of a run that fails or goes on for too long.
MODEL_ERROR, STOPPED = "model error: ", "agent stopped after reaching the %d iteration limit"

OUTPUTS = "run_id string, iteration int, kind string, calls int, status string, message string"
OUTCOMES = "run_id string, status string, message string, iterations int, executed_calls long, refused_batches long, first_refused int, refusal string"


def outcomes(outputs: DataFrame, most: int = ITERATIONS, limit: int = CALLS) -> DataFrame:
    """A row (``OUTCOMES``) for each run of ``outputs`` (``OUTPUTS``; ``kind`` is tool_calls, final or error).

    ``status`` is that of the final answer, failure for an error, max_iterations, or running while
    outputs are still to come. Calls of refused batches aren't executed; ``refusal`` is said of the
    first of them. A null number of calls is an empty batch. Runs of any length have slim rows
    and map-side partial aggregates.
    """
    if most < 1 or limit < 1:
        raise ValueError("limits must be positive")
    ends = F.col("kind").isin("final", "error") & (F.col("iteration") <= most)
    told = F.struct("kind", "status", "message", "iteration")
    runs = outputs.groupBy("run_id").agg(F.min_by(F.when(ends, told), F.when(ends, F.col("iteration"))).alias("end"), F.max("iteration").alias("seen"))
    runs = runs.withColumn("iterations", F.coalesce("end.iteration", F.least("seen", F.lit(most))))
    called = outputs.where("kind = 'tool_calls'").withColumn("calls", F.coalesce("calls", F.lit(0)))
    rows = called.join(runs.select("run_id", "iterations"), "run_id").where(F.col("iteration") <= F.col("iterations"))
    fine = F.col("calls").between(1, limit)
    why = F.when(F.col("calls") == 0, EMPTY).otherwise(F.format_string(TOO_MANY, F.col("calls"), F.lit(limit)))
    each = rows.groupBy("run_id").agg(
        F.sum(F.when(fine, F.col("calls")).otherwise(0)).alias("executed_calls"),
        F.count_if(~fine).alias("refused_batches"),
        F.min(F.when(~fine, F.col("iteration"))).alias("first_refused"),
        F.min_by(F.when(~fine, why), F.when(~fine, F.col("iteration"))).alias("refusal"),
    )
    over = F.col("seen") >= most
    status = F.when(F.col("end.kind") == "error", "failure").when(F.col("end").isNotNull(), F.col("end.status")).when(over, "max_iterations").otherwise("running")
    failed = F.when(F.col("end.message").isNull(), "model error").otherwise(F.concat(F.lit(MODEL_ERROR), "end.message"))
    message = F.when(F.col("end.kind") == "error", failed).when(F.col("end").isNotNull(), F.col("end.message")).when(over, STOPPED % most)
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return runs.join(each, "run_id", "left").select("run_id", status.alias("status"), message.alias("message"), "iterations", count("executed_calls"), count("refused_batches"), "first_refused", "refusal")
