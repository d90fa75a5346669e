"""Agent runs folded as their outputs arrive; the same outcomes as ``operators.runs`` in batch."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.runs import CALLS, EMPTY, ITERATIONS, MODEL_ERROR, OUTCOMES, STOPPED, TOO_MANY

_STATE = "at int, executed long, refused long, first int, refusal string, over boolean, waiting string"


def outcomes(outputs: DataFrame, most: int = ITERATIONS, limit: int = CALLS) -> DataFrame:
    """A row (``OUTCOMES``) for each run of a stream of ``OUTPUTS`` once it has ended.

    Outputs may come in any order and in any batch: one that comes before its turn waits in the
    run's state, which holds at most ``most`` of them. One that comes again, or after the end, is
    left out. The state of an ended run is one flag.
    """

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, executed, refused, first, refusal, over, waiting = state.get if state.exists else (0, 0, 0, None, None, False, "{}")
        if over:
            return
        held = {int(i): o for i, o in json.loads(waiting).items()}
        for frame in frames:
            for i, kind, calls, status, message in frame[["iteration", "kind", "calls", "status", "message"]].itertuples(index=False):
                if at < i <= most and i not in held:
                    held[int(i)] = [None if pd.isna(v) else v for v in (kind, calls, status, message)]
        end = None
        while end is None and at + 1 in held:
            at += 1
            kind, calls, status, message = held.pop(at)
            calls = int(calls or 0)
            if kind == "error":
                end = ("failure", "model error" if message is None else MODEL_ERROR + message)
            elif kind == "final":
                end = (status, message)
            elif kind == "tool_calls" and 1 <= calls <= limit:
                executed += calls
            elif kind == "tool_calls":
                refused += 1
                if first is None:
                    first, refusal = at, TOO_MANY % (calls, limit) if calls else EMPTY
            if end is None and at == most:
                end = ("max_iterations", STOPPED % most)
        if end is None:
            state.update((at, executed, refused, first, refusal, False, json.dumps({i: [k, None if c is None else int(c), s, m] for i, (k, c, s, m) in held.items()})))
            return
        state.update((at, executed, refused, first, refusal, True, "{}"))
        yield pd.DataFrame([(key[0], *end, at, executed, refused, first, refusal)], columns=[c.split()[0] for c in OUTCOMES.split(", ")])

    return outputs.groupBy("run_id").applyInPandasWithState(fold, OUTCOMES, _STATE, "append", GroupStateTimeout.NoTimeout)
