"""Requests and the answers that belong to them, by id and time; in batch and in streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _seconds(n: int) -> Column:
    return F.make_interval(secs=F.lit(n))


def correlated(requests: DataFrame, answers: DataFrame, within: int) -> DataFrame:
    """(id, asked_at, request, answered_at, answer) of all requests and answers (id, at, and a body of that name).

    An answer belongs to a request of its id that was asked at most ``within`` seconds before it;
    several may. Nulls stand for what is missing: a request's answer, or an answer's request where
    it came too late or nobody asked. Null ids belong to nothing. Streams need a watermark on
    ``at`` on both sides; what is missing is told once the watermark has passed.
    """
    r = requests.select(F.col("id").alias("_r"), F.col("at").alias("asked_at"), "request")
    a = answers.select(F.col("id").alias("_a"), F.col("at").alias("answered_at"), "answer")
    # a stream's join lets null keys meet, so they are kept apart by the condition
    on_time = F.col("_r").isNotNull() & (F.col("answered_at") >= F.col("asked_at")) & (F.col("answered_at") <= F.col("asked_at") + _seconds(within))
    return r.join(a, (F.col("_r") == F.col("_a")) & on_time, "full").select(F.coalesce("_r", "_a").alias("id"), "asked_at", "request", "answered_at", "answer")


def outcomes(requests: DataFrame, answers: DataFrame, within: int) -> DataFrame:
    """A row for each id: (id, outcome, answered_at, on_time, late, early).

    ``outcome`` is answered, repeated (several answers on time; the first counts), late (answers
    after the time only), missing, or unknown (nobody asked). The first request of an id counts.
    Both sides are reduced by id with map-side partial aggregates before they meet, but for the
    answers, which are compared with their request's time.
    """
    asked = requests.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("at").alias("asked_at"))
    told = answers.where(F.col("id").isNotNull()).select("id", "at").join(asked, "id", "full")
    late, early = F.col("at") > F.col("asked_at") + _seconds(within), F.col("at") < F.col("asked_at")
    on_time = F.col("at").between(F.col("asked_at"), F.col("asked_at") + _seconds(within))
    each = told.groupBy("id").agg(F.max(F.col("asked_at").isNotNull()).alias("asked"), F.min(F.when(on_time, F.col("at"))).alias("answered_at"), *(F.count_if(c).alias(n) for n, c in (("on_time", on_time), ("late", late), ("early", early))))
    outcome = F.when(~F.col("asked"), "unknown").when(F.col("on_time") == 1, "answered").when(F.col("on_time") > 1, "repeated").when(F.col("late") > 0, "late").otherwise("missing")
    return each.select("id", outcome.alias("outcome"), "answered_at", "on_time", "late", "early")
