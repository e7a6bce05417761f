"""Prefix trees against a plain walk over all conversations."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from shoebox.llm import prefixtrie

SCHEMA = "conv_id long, turn long, role string, text string, d long, a string, block int, tail string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 5, "x", 1, "t") for r in rows], SCHEMA)


def plain(rows, family=20, most=4):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns.setdefault(c, []).append((turn is not None, turn or 0, key, (role, text)))
    turns = {c: [t for *_, t in sorted(ts)] for c, ts in turns.items()}
    members, ended, children = {}, {}, {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % most
        donor = c - (c % family if c >= 0 else -(-c % family))
        seq = tuple(turns.get(donor, [])[:h] + own[h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
            if d:
                children.setdefault(seq[: d - 1], set()).add(seq[:d])
        ended.setdefault(seq, []).append(c)
    leaves, saved = {}, {}
    for node, who in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] = leaves.get(node[:d], 0) + (node not in children)
            saved[node[:d]] = saved.get(node[:d], 0) + (len(who) - 1) * words
    return sorted(
        (
            min(who), len(node), min(members[node[:-1]]) if node else -1, len(who), len(children.get(node, ())), leaves[node], saved[node],
            hashlib.sha256(",".join(map(str, sorted(ended.get(node, [])))).encode()).hexdigest(),
        )
        for node, who in members.items()
    )


def found(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def conversations(seed, n, most_turns=7):
    """Few first turns, so that many conversations begin alike; some are copies of others."""
    rng = np.random.default_rng(seed)
    rows, kept = [], []
    for c in range(n):
        if kept and rng.random() < 0.2:
            seq = kept[rng.integers(len(kept))]
        else:
            seq = [("user" if t % 2 else "system", f"t{rng.integers(2 if t < 2 else 50)}  word\t{rng.integers(3)}") for t in range(rng.integers(1, most_turns))]
            kept.append(seq)
        rows += [(c * 3 - 40, t, *turn) for t, turn in enumerate(seq)]
    return rows


@pytest.mark.parametrize("cells", [1 << 14, 1 << 16])
def test_tree_equals_plain_walk(spark, cells):
    rows = conversations(1, 150)
    got = prefixtrie.prefix_tree(frame(spark, rows), screen=prefixtrie.Screen(most_cells=cells))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert found(got) == plain(rows)


def test_sketch_that_is_full_proves_nothing_and_changes_nothing(spark, monkeypatch):
    rows = conversations(2, 60)
    whole = np.full((4, (1 << 14) // 4), 0xAA, np.uint8)
    monkeypatch.setattr(prefixtrie, "sketch", lambda *args: whole)
    assert found(prefixtrie.prefix_tree(frame(spark, rows))) == plain(rows)


def test_one_conversation_and_one_first_turn_hold_most_rows(spark):
    rows = [(7, t, "user", f"turn {t}") for t in range(900)] + [(c, 0, "system", "same") for c in range(100, 700)]
    rows += [(c, 1, "user", "same too" if c % 2 else f"own {c}") for c in range(100, 700)]
    assert found(prefixtrie.prefix_tree(frame(spark, rows))) == plain(rows)


def test_awkward_rows(spark):
    rows = [(None, 1, "user", "lost"), (1, None, None, None), (1, 2, "", ""), (1, 2, "", ""), (2, 5, "user", "a" * 50_000), (2, 5, "user", "b"), (-5, 1, "user", " \t\n ")]
    rows += [(20, 1, "user", "ab"), (21, 1, "usera", "b"), (21, 2, "user", "é 😀 x"), (22, 1, "user", "ab"), (22, None, "user", "first"), (9223372036854775807, 0, "user", "ab")]
    assert found(prefixtrie.prefix_tree(frame(spark, rows))) == plain(rows)
    assert prefixtrie.prefix_tree(frame(spark, [])).count() == 0
