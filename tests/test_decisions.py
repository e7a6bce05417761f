"""Decision fold against applying the log one action after the other."""

import random

import pytest

from shoebox.operators import decisions

LOG = "seq long, action string, image_ids array<long>, group_id long, keeper_id long"


def _log(seed, n=300, resets=True):
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        kind = rng.choice(["keep", "mark", "toggle", "toggle", "keep_all", "mark_all", "assign_keeper"])
        if resets and rng.random() < 0.01:
            kind = "reset"
        # One image takes a large share of the actions.
        one = 0 if rng.random() < 0.4 else rng.randrange(12)
        ids = {"keep_all": [one, one, (one + 1) % 12], "mark_all": [one, (one + 5) % 12]}.get(kind, [one])
        keeper = kind == "assign_keeper"
        rows.append((seq, kind, None if keeper or kind == "reset" else ids, one if keeper else None, seq if keeper else None))
    return rows


def _apply(rows):
    kept, deleted, keepers, touched = set(), set(), {}, {}
    for seq, kind, ids, group, keeper in rows:
        if kind == "reset":
            kept, deleted, keepers, touched = set(), set(), {}, {}
        elif kind == "assign_keeper":
            keepers[group] = keeper
        else:
            for i in dict.fromkeys(ids):
                keep = kind in ("keep", "keep_all") or (kind == "toggle" and i in deleted)
                (kept if keep else deleted).add(i)
                (deleted if keep else kept).discard(i)
                touched[i] = seq
    return {i: ("EXPLICIT_KEEP", touched[i]) for i in kept} | {i: ("EXPLICIT_DELETE", touched[i]) for i in deleted}, keepers


@pytest.mark.parametrize("seed,span,resets", [(1, 1 << 20, True), (2, 7, True), (3, 1, False), (4, 50, False)])
def test_fold(spark, seed, span, resets):
    rows = _log(seed, resets=resets)
    log = spark.createDataFrame(rows, LOG).repartition(4)
    want, keepers = _apply(rows)
    got = {r.image_id: (r.decision, r.updated_at) for r in decisions.fold(decisions.settled_log(log), span).collect()}
    assert got == want
    assert {r.group_id: r.keeper_id for r in decisions.fold_keepers(decisions.after_reset(log)).collect()} == keepers


def test_toggle_on_undecided_deletes_and_reset_forgets(spark):
    rows = [(1, "mark", [5], None, None), (2, "reset", None, None, None), (3, "toggle", [5], None, None), (4, "toggle", [6], None, None), (5, "toggle", [6], None, None)]
    got = decisions.fold(decisions.after_reset(spark.createDataFrame(rows, LOG))).collect()
    assert {r.image_id: r.decision for r in got} == {5: "EXPLICIT_DELETE", 6: "EXPLICIT_KEEP"}


def test_later_group_wins_and_empty_keeper_is_none(spark):
    members = spark.createDataFrame([(1, "a", "a"), (1, "b", "a"), (2, "b", "c"), (2, "c", "c"), (3, "d", "")], "group_id long, image_id string, recommended_id string")
    keepers = spark.createDataFrame([(1, "b")], "group_id long, keeper_id string")
    mapped = decisions.keeper_map(members, keepers)
    assert {r.image_id: r.keeper_id for r in mapped.collect()} == {"a": "b", "b": "c", "c": "c", "d": ""}
    none = spark.createDataFrame([], "image_id string, decision string, updated_at long")
    marks = decisions.marked_for_deletion(members.select("image_id").distinct(), none, "similar", keepers=mapped)
    assert {r.image_id: r.marked for r in marks.collect()} == {"a": True, "b": True, "c": False, "d": False}
    with pytest.raises(ValueError):
        decisions.marked_for_deletion(members, none, "other")


def test_saved_decisions(spark):
    standing = spark.createDataFrame([("a", "EXPLICIT_KEEP", 1), ("b", "EXPLICIT_DELETE", 2)], "image_id string, decision string, updated_at long")
    keepers = spark.createDataFrame([(7, "a")], "group_id long, keeper_id string")
    got = {tuple(r) for r in decisions.saved_decisions(standing, keepers).collect()}
    assert got == {("explicit_kept", "a"), ("explicit_deleted", "b"), ("keeper", "7:a")}
