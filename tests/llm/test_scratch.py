"""Step tables go with the operator that made them."""

import os

from curastra.llm.common import materialize, scratch, shared_dir


def test_steps_are_deleted_and_lasting_tables_stay(spark):
    root = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(root))
    with scratch(spark):
        step = materialize(spark.range(5), "step")
        kept = materialize(step.where("id > 1"), "kept", lasting=True)
    assert {n.split("-")[0] for n in set(os.listdir(root)) - before} == {"kept"} and kept.count() == 3


def test_groups_leave_only_their_members(spark, frame):
    from curastra.llm.ngram_join import similar_groups

    root = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(root))
    out = similar_groups(frame([(k, "a b c d e f g h " * 4 + ("x" if k > 3 else "")) for k in range(6)]))
    assert {n.split("-")[0] for n in set(os.listdir(root)) - before} == {"members"} and out.count() == 6
