"""Chat samples: messages from turns, rendering, labels that mask the prompt, repair requests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The label that a trainer ignores; the paragraphs of a repair request around
#: the request and the evaluation.
IGNORED = -100
REPAIR = {
    "continue": "Continue working in the existing task workspace.",
    "number": "This is evaluator-guided repair %d of at most %d.",
    "inspect": "Inspect the existing files and fix the implementation so the original request passes.",
    "leave": "Do not modify or replace the external evaluator; it is outside your workspace.",
    "request": "Original request:",
    "result": "External evaluator result:",
    "check": "Run the relevant allowed build or test command and inspect its Observation before finishing.",
}


#: Turns whose places may share a row before a conversation is put together.
BLOCK = 64


def messages_of(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", first: int | None = None) -> DataFrame:
    """(conv, messages) in order of turns; with ``first``, the first message and those with a
    role and a content, up to so many.

    Turns are gathered by blocks of their numbers, and blocks by conversation: of a long
    conversation one task reads a row for each block, with ``first`` a short one.
    """

    def gathered(found: Column) -> Column:
        found = F.array_sort(found)
        return found if first is None else F.slice(F.filter(found, lambda m, i: (i == 0) | (m["role"].isNotNull() & m["content"].isNotNull())), 1, first)

    message = F.struct(F.col(turn), F.col(role).alias("role"), F.col(text).alias("content"))
    blocks = turns.groupBy(conv, F.floor(F.col(turn) / BLOCK).alias("_b")).agg(gathered(F.collect_list(message)).alias("m"))
    whole = blocks.groupBy(conv).agg(gathered(F.flatten(F.collect_list("m"))).alias("m"))
    return whole.select(conv, F.transform("m", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("messages"))


def is_pair(turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, valid): whether a conversation is one user and one assistant turn with content."""
    filled = F.col("text").rlike(r"(?U)\S")
    user = F.count_if((F.col("turn") == 0) & (F.col("role") == "user") & filled)
    reply = F.count_if((F.col("turn") == 1) & (F.col("role") == "assistant") & filled)
    return turns.groupBy(conv).agg(((F.count("*") == 2) & (user == 1) & (reply == 1)).alias("valid"))


def render(messages: Column, opened: bool = False) -> Column:
    """The text of messages in the chat template; ``opened`` adds the start of a reply."""
    text = F.array_join(F.transform(messages, lambda m: F.concat(F.lit("<|im_start|>"), m["role"], F.lit("\n"), m["content"], F.lit("<|im_end|>\n"))), "")
    return F.concat(text, F.lit("<|im_start|>assistant\n")) if opened else text


def masked(prompt_ids: Column, full_ids: Column, max_length: int) -> Column:
    """struct(input_ids, attention_mask, labels, error) with labels over the response only.

    ``error`` is set where the prompt isn't a prefix, or nothing of the response is left.
    """
    kept = F.slice(full_ids, 1, max_length)
    n = F.least(F.size(prompt_ids), F.size(kept))
    # one slice from place n + 1 on; a slice may be empty but not start after the end
    rest = F.when(n < F.size(kept), F.slice(kept, n + 1, F.greatest(F.size(kept) - n, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    labels = F.concat(F.array_repeat(F.lit(IGNORED), n), rest)
    prefix = F.slice(full_ids, F.lit(1), F.size(prompt_ids)) == prompt_ids
    error = F.when(~prefix, "the prompt is no prefix").when(~F.exists(labels, lambda x: x != IGNORED), "nothing of the response is left")
    return F.struct(kept.alias("input_ids"), F.array_repeat(F.lit(1), F.size(kept)).alias("attention_mask"), labels.alias("labels"), error.alias("error"))


Encode = Callable[[list[str]], list[list[int]]]
#: What this worker has loaded, by name.
_ENCODERS: dict[str, Encode] = {}
#: Bytes of a row's texts that are encoded together (or one row): ids, and what an encoder keeps
#: beside them, are many times that. Rows of a batch that comes from Spark.
_TOGETHER, _ROWS = 500_000, 2_000


def _parts(batch: pa.RecordBatch, texts: list[str]) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``_TOGETHER`` bytes of the columns; nothing is copied."""
    size = sum(pc.binary_length(batch.column(t)).fill_null(0).to_numpy().astype(np.int64) for t in texts)
    at = np.cumsum(size) // _TOGETHER
    bounds = [0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), batch.num_rows]
    yield from (batch.slice(a, b - a) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a)


def encoded(rows: DataFrame, load: Callable[[], Encode], name: str, **columns: str) -> DataFrame:
    """Rows with the ids of text columns (new column = text column), by an encoder of the caller's.

    ``load`` gives a function from texts to lists of ids; a worker calls it once and keeps what it
    gives under ``name``. Texts go to it in parts of bounded size, and each part's ids leave the
    worker before the next ones are made. A null text has null ids.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(rows.sparkSession.conf.get(key)) <= _ROWS:
        rows.sparkSession.conf.set(key, str(_ROWS))  # changes memory, not results

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _ENCODERS:
            _ENCODERS[name] = load()
        encode = _ENCODERS[name]
        for part in (p for batch in batches for p in _parts(batch, list(columns.values()))):
            more = []
            for text in columns.values():
                texts = part.column(text).to_pylist()
                ids = iter(encode([t for t in texts if t is not None]))
                more.append(pa.array([None if t is None else next(ids) for t in texts], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, *columns])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema] + [f"`{c}` array<int>" for c in columns]
    return rows.mapInArrow(run, ", ".join(kinds))


def tokenized_samples(conversations: DataFrame, load: Callable[[], Encode], name: str, max_length: int) -> DataFrame:
    """Samples to train on, from (id, messages): (id, input_ids, attention_mask, labels, error).

    The prompt is the first message and the start of a reply; labels cover what follows. The ids
    of the prompt alone have to begin those of the whole, or the sample has an error.
    """
    key = next(c for c in conversations.columns if c != "messages")
    texts = conversations.select(key, render(F.slice("messages", 1, 1), opened=True).alias("_prompt"), render(F.col("messages")).alias("_whole"))
    ids = encoded(texts, load, name, _prompt_ids="_prompt", _whole_ids="_whole")
    return ids.select(key, masked(F.col("_prompt_ids"), F.col("_whole_ids"), max_length).alias("_m")).select(key, "_m.*")


def code_points(text: Column) -> Column:
    """A stand-in for a tokenizer: a text's characters as numbers."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?s)(.)"), F.lit(1)), lambda c: F.ascii(c))


def repair_request(request: Column, evaluation: Column, number: Column, most: Column) -> Column:
    """What an agent is asked after a failed evaluation (a JSON string)."""
    part = {name: F.lit(text) for name, text in REPAIR.items()} | {"number": F.format_string(REPAIR["number"], number, most)}
    order = [part["continue"], part["number"], part["inspect"], part["leave"], part["request"], request, part["result"], evaluation, part["check"]]
    return F.concat_ws("\n\n", *order)
