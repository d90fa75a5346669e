"""Model stages over an injected transport: bounded requests in flight, retries, failures as rows.

The transport is a function of a record (a dict) that returns the answer as a dict; where
it comes from is no concern of this library. A partition has its own few threads, so a stage
has ``in_flight`` times its running tasks of requests under way.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.merge import merge_columns
from ..functions.text import strip
from ..operators.components import stored
from ..operators.gates import PIPELINE
from ..operators.joins import pending
from ..schemas import SCOPE

Transport = Callable[[dict], dict]

#: Tries of a request, and seconds of a pause at most; how an error starts.
TRIES, LONGEST = 4, 8
FAILED = "request failed after %d attempts: "


class Refused(Exception):
    """A transport's error that no retry can mend, such as a request that is not allowed."""


def asking(transport: Transport, tries: int = TRIES, in_flight: int = 8, pause: Callable[[float], None] = time.sleep) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function for ``mapInPandas``: the rows with ``answer`` (JSON), ``error``, ``tries`` and ``seconds``.

    Between tries it pauses for 1, 2, 4, then ``LONGEST`` seconds. A request that fails for good has a
    null answer and an error; it stops neither its batch nor its task.
    """

    def ask(record: dict) -> tuple[str | None, str | None, int, float]:
        began = time.monotonic()
        for n in range(1, tries + 1):
            try:
                return json.dumps(transport(record), ensure_ascii=False), None, n, time.monotonic() - began
            except Refused as e:
                return None, str(e) or type(e).__name__, n, time.monotonic() - began
            except Exception as e:  # whatever a transport raises: the request may succeed later
                why = str(e) or type(e).__name__
            if n < tries:
                pause(min(2 ** (n - 1), LONGEST))
        return None, FAILED % tries + why, tries, time.monotonic() - began

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(in_flight) as pool:
            for frame in frames:
                told = list(pool.map(ask, json.loads(frame.to_json(orient="records")) if len(frame) else []))
                answer, error, count, seconds = zip(*told, strict=True) if told else ((), (), (), ())
                yield frame.assign(answer=list(answer), error=list(error), tries=list(count), seconds=list(seconds))

    return run


def ask(rows: DataFrame, transport: Transport, **settings) -> DataFrame:
    """Rows with what ``asking`` adds, stored, so that no request is made again for a later use.

    Rows of a task that is run again after a loss are asked again; an executor's loss costs no others.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return stored(rows.mapInPandas(asking(transport, **settings), f"{kinds}, answer string, error string, tries int, seconds double"), lasting=True)


def generated(units: DataFrame, done: DataFrame, prompt: F.Column, transport: Transport, model: str, max_output_tokens: int = 900, **settings) -> tuple[DataFrame, DataFrame]:
    """(instruction records, failures (unit_id, error, tries)) for the units that have no record yet.

    The transport gets ``unit_id`` and ``prompt`` and answers with the scope's fields, ``instruction``
    and, as it likes, ``status`` and ``response_id``. A record is the unit, its scope and its
    generation, merged. Failed units get no record: they are neither accepted nor rejected, and
    are asked again by the next run. An answer that isn't of that shape fails, too.
    """
    rest = stored(pending(units, done, "unit_id"), lasting=True)
    asked = ask(rest.select("unit_id", prompt.alias("prompt")), transport, **settings)
    shape = SCOPE.removesuffix(">") + ",instruction:string,status:string,response_id:string>"
    told = asked.withColumn("a", F.from_json("answer", shape))
    ok = F.col("error").isNull() & F.col("a.instruction").isNotNull()
    failures = told.where(~ok).select("unit_id", F.coalesce("error", F.lit("the answer has no instruction")).alias("error"), "tries")
    scope = F.struct(*(F.col(f"a.{n}").alias(n) for n in ("target_file", "target_symbol", "expected_behavior", "constraints", "required_context")))
    generation = F.struct(
        F.lit(PIPELINE).alias("pipeline_version"),
        F.lit(model).alias("model"),
        F.lit("structured_code_to_instruction").alias("method"),
        F.lit("structured_json").alias("decode"),
        F.lit(max_output_tokens).alias("max_output_tokens"),
        F.col("a.status").eqNullSafe(F.lit("completed")).alias("response_completed"),
        F.col("a.response_id").alias("response_id"),
        F.col("a.status").alias("status"),
        F.round("seconds", 3).alias("duration_seconds"),
    )
    more = told.where(ok).select("unit_id", F.struct(scope.alias("scope"), strip(F.col("a.instruction")).alias("instruction"), generation.alias("generation")).alias("more"))
    both = rest.select("unit_id", F.struct(*rest.columns).alias("unit")).join(more, "unit_id")
    return merge_columns(both, "unit", "more", deep=False), failures
