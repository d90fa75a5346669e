"""Preference pairs: a shared prompt and two completions with loss masks.

Of the chosen and the rejected conversation the longest common prefix of turns is the
prompt, rendered once; what follows in each is its completion, in which the assistant's
turns count for the loss. Conversations are never gathered into a row: turns are compared
by joins on (conversation, place), the first difference is a minimum with map-side partial
aggregates, and the result has a row for each rendered turn. So neither a conversation nor
a prompt with a third of all rows meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: How a turn is rendered.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit("\n"), text, F.lit(CLOSE + "\n"))


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text) with one row for each place.

    Rows without a conversation or turn are left out. Of several rows for one place the one
    with the smallest (role, text) counts. A null role or text is empty.
    """
    rows = conversations.select(conversations[conv_col].cast("long").alias("conv"), conversations[turn_col].cast("long").alias("turn"), F.coalesce(conversations[role_col].cast("string"), F.lit("")).alias("role"), F.coalesce(conversations[text_col].cast("string"), F.lit("")).alias("text"))
    one = rows.where("conv is not null and turn is not null").groupBy("conv", "turn").agg(F.min(F.struct("role", "text")).alias("m"))
    return one.select("conv", "turn", "m.role", "m.text")


def pair_by_opening(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Pairs (chosen, rejected) of conversations that open with the same user turn.

    Among conversations with the same first user turn, the one with the most text in
    ``loss_role`` turns (ties: the smallest id) is chosen against each of the others; so a
    group gives one pair less than it has conversations. Preference data with verdicts of
    its own needs no pairing.
    """
    own = F.col("role") == loss_role
    opening = F.min(F.when(F.col("role") == "user", F.struct("turn", F.xxhash64("text").alias("a"), F.sha2("text", 256).alias("b"))))
    conv = turns.groupBy("conv").agg(opening.alias("first"), F.sum(F.when(own, F.length("text")).otherwise(0)).alias("size")).where("first is not null")
    conv = materialize(conv.select("conv", F.col("first.b").alias("opening"), "size"), "openings")
    best = conv.groupBy("opening").agg(F.min(F.struct((-F.col("size")).alias("s"), "conv")).alias("best"), F.count("*").alias("n")).where("n > 1")
    return conv.join(best, "opening").where(F.col("conv") != F.col("best.conv")).select(F.col("best.conv").alias("chosen"), F.col("conv").alias("rejected"))


def swapped_answers(turns: DataFrame, loss_role: str = "assistant") -> tuple[DataFrame, DataFrame]:
    """Negative samples: (turns of new conversations, pairs with them).

    For each conversation 2k and 2k + 1 that has a last ``loss_role`` turn, the new
    conversation -1 - id has the same turns up to that one and there the last ``loss_role``
    text of the other of the two; it is rejected against the original. Without the other's
    answer there is no pair. Ids must not be negative.
    """
    last = turns.where(F.col("role") == loss_role).groupBy("conv").agg(F.max(F.struct("turn", "text")).alias("last"))
    last = materialize(last.where("conv >= 0").select("conv", F.col("last.turn").alias("until"), F.col("last.text").alias("answer")), "answers")
    other = last.select(F.col("conv").bitwiseXOR(F.lit(1).cast("long")).alias("conv"), F.col("answer").alias("swapped"))
    plan = last.select("conv", "until").join(other, "conv")
    text = F.when(F.col("turn") == F.col("until"), F.col("swapped")).otherwise(F.col("text"))
    new = turns.join(plan, "conv").where(F.col("turn") <= F.col("until")).select((-1 - F.col("conv")).alias("conv"), "turn", "role", text.alias("text"))
    return new, plan.select(F.col("conv").alias("chosen"), (-1 - F.col("conv")).alias("rejected"))


def format_preferences(turns: DataFrame, pairs: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Rendered turns of preference pairs.

    ``turns`` as ``turns_of`` returns them, ``pairs`` with ``chosen`` and ``rejected`` ids.
    Returns for each pair (``chosen``, ``rejected``) a row for each turn: ``part`` (prompt,
    chosen, rejected), ``place`` (0, 1, ... in the conversation), ``role``, ``rendered`` and
    ``loss`` (true for ``loss_role`` turns of the completions only). The common prefix is
    the turns with equal role and text at equal places, from the first on. Equal
    conversations are all prompt and give no completion rows; conversations without turns
    give none. Repeated pairs count once; pairs with a null id or of one conversation with
    itself are left out.
    """
    pairs = pairs.select(F.col("chosen").cast("long"), F.col("rejected").cast("long")).where("chosen <> rejected").distinct()
    hashed = materialize(_placed(turns), "turns")
    slim = hashed.select("conv", "place", "digest")
    # a chosen conversation may face very many rejected ones: its turns are joined by place
    left = pairs.join(slim.select(F.col("conv").alias("rejected"), "place", F.col("digest").alias("d")), "rejected")
    both = left.join(slim.select(F.col("conv").alias("chosen"), "place", F.col("digest").alias("c")), ["chosen", "place"], "left")
    differ = both.groupBy("chosen", "rejected").agg(F.min(F.when(~F.col("d").eqNullSafe(F.col("c")), F.col("place"))).alias("at"), F.max("place").alias("last"))
    common = materialize(differ.select("chosen", "rejected", F.coalesce("at", F.col("last") + 1).alias("common")), "prefixes")

    def part(name: str, side: str, keep: Column) -> DataFrame:
        own = hashed.select(F.col("conv").alias(side), "place", "role", "text")
        loss = (F.col("role") == loss_role) & F.lit(name != "prompt")
        return common.join(own, side).where(keep).select("chosen", "rejected", F.lit(name).alias("part"), "place", "role", rendered(F.col("role"), F.col("text")).alias("rendered"), loss.alias("loss"))

    prompt = part("prompt", "rejected", F.col("place") < F.col("common"))
    rest = F.col("place") >= F.col("common")
    return prompt.unionByName(part("chosen", "chosen", rest)).unionByName(part("rejected", "rejected", rest))


def _placed(turns: DataFrame) -> DataFrame:
    """Turns with their place from 0 and a digest of role and text.

    The place is the rank of the turn number. It is found with counts of blocks of turn
    numbers, so the turns of one conversation are spread over tasks by block.
    """
    block = F.floor(F.col("turn") / 1024)
    counts = turns.groupBy("conv", block.alias("block")).agg(F.count("*").alias("n"))
    before = counts.groupBy("conv").agg(F.collect_list(F.struct("block", "n")).alias("blocks"))
    within = F.row_number().over(Window.partitionBy("conv", "block").orderBy("turn")) - 1
    rows = turns.withColumn("block", block).withColumn("within", within).join(before, "conv")
    earlier = F.aggregate(F.filter("blocks", lambda b: b["block"] < F.col("block")), F.lit(0).cast("long"), lambda s, b: s + b["n"])
    digest = F.sha2(F.concat_ws("\u0000", "role", "text"), 256)
    return rows.select("conv", (F.col("within") + earlier).alias("place"), "role", "text", digest.alias("digest"))


def oracle() -> str:
    """DuckDB SQL for preferences over ``conversations`` paired by opening and by swapped answers."""
    return f"""
WITH t AS (SELECT DISTINCT ON (conv_id, turn) conv_id AS conv, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL ORDER BY conv_id, turn, coalesce(role, ''), coalesce(text, '')),
o AS (SELECT conv, arg_min(text, turn) FILTER (role = 'user') AS opening, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS size FROM t GROUP BY conv),
b AS (SELECT *, first_value(conv) OVER (PARTITION BY opening ORDER BY size DESC, conv) AS best FROM o WHERE opening IS NOT NULL),
last AS (SELECT conv, max(turn) AS until, arg_max(text, turn) AS answer FROM t WHERE role = 'assistant' AND conv >= 0 GROUP BY conv),
plan AS (SELECT x.conv, x.until, y.answer AS swapped FROM last x JOIN last y ON y.conv = xor(x.conv, 1)),
u AS (SELECT conv, turn, role, text FROM t UNION ALL
  SELECT -1 - conv, turn, role, CASE WHEN turn = until THEN swapped ELSE text END FROM t JOIN plan USING (conv) WHERE turn <= until),
p AS (SELECT best AS chosen, conv AS rejected FROM b WHERE conv <> best UNION ALL SELECT conv, -1 - conv FROM plan),
n AS (SELECT conv, role, text, row_number() OVER (PARTITION BY conv ORDER BY turn) - 1 AS place FROM u),
d AS (SELECT chosen, rejected, coalesce(min(CASE WHEN c.conv IS NULL OR c.role <> r.role OR c.text <> r.text THEN r.place END), max(r.place) + 1) AS common
  FROM p JOIN n r ON r.conv = rejected LEFT JOIN n c ON c.conv = chosen AND c.place = r.place GROUP BY ALL),
parts AS (SELECT d.*, 'prompt' AS part, n.* FROM d JOIN n ON n.conv = rejected WHERE place < common
  UNION ALL SELECT d.*, 'chosen', n.* FROM d JOIN n ON n.conv = chosen WHERE place >= common
  UNION ALL SELECT d.*, 'rejected', n.* FROM d JOIN n ON n.conv = rejected WHERE place >= common)
SELECT chosen, rejected, part, place, role, '{OPEN}' || role || chr(10) || text || '{CLOSE}' || chr(10) AS rendered, role = 'assistant' AND part <> 'prompt' AS loss FROM parts"""
