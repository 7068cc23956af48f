import hashlib
import random
import zlib

import pytest

from pulsegrid.llm import trie
from tests.llm.cases import SF

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    """Nodes from dictionaries of prefixes; rows are (conv_id, turn, role, text)."""
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [v[2:] for v in sorted(turns, key=lambda v: v[:2])] for c, turns in convs.items()}
    rebuilt = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    members = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out = []

    def walk(node):
        leaves = saved = 0
        for kid in children.get(node, []):
            l, s = walk(kid)
            leaves, saved = leaves + l, saved + s
        n = len(members[node])
        saved += (n - 1) * len(node[-1][1]) if node else 0
        leaves = leaves or 1
        ends = sorted(c for c in members[node] if len(rebuilt[c]) == len(node))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, n, len(children.get(node, [])),
                    leaves, saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
        return leaves, saved

    if rebuilt:
        walk(())
    return sorted(out, key=repr)


def rows_of(df):
    return [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]


def check(df, width):
    got = trie.conversation_trie(df, width)
    assert sorted(got.columns) == sorted(COLUMNS)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.collect()), key=repr) == brute(rows_of(df))


def awkward(spark, width):
    """Nulls, hot and equal conversations, ones that end where others go on, repeated rows, long ones."""
    rng = random.Random(3)
    rows = [(None, 0, "user", "nobody's"), (1, None, None, None), (1, 2, "user", None), (1, 1, None, "x"), (2, 0, "", ""), (2, 1, "user", "")]
    rows += [(c, t, "user" if t % 2 else "assistant", f"turn {t}") for c in range(300, 360) for t in range(min(14, 2 * width + 1))]  # one text for all
    rows += [(c, t, "user", f"turn {t}") for c in range(400, 420) for t in range(width + 1 + c % 3)]
    rows += [(c, t, "user", rng.choice("abc")) for c in range(500, 560) for t in range(rng.randrange(1, min(9, 2 * width + 2)))]
    rows += [(c, t, "user", "same") for c in (700, 701, 702, 707) for t in range(2 * width + 2 + c % 2)]
    rows += [(800, 0, "user", "twice")] * 3 + [(-5, 0, "user", "less"), (-105, 0, "user", "\U0001f600é")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.selectExpr("*", "1 as k", "'x' as ids", "2 as depth", "3 as len").repartition(5)


@pytest.mark.parametrize("width", [32, 3])
def test_awkward_conversations_match_brute_force(spark, width):
    check(awkward(spark, width), width)


def test_given_conversations_match_brute_force(spark):
    check(spark.read.parquet(f"{SF}/conversations.parquet"), 32)


def test_no_conversations_give_no_nodes(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.conversation_trie(none).collect() == []


def test_turnless_conversations_end_at_the_root(spark):
    few = [(c, 0, "user", "x") for c in range(101, 130)]  # all their turns fall under the head of an absent one
    df = spark.createDataFrame(few, "conv_id long, turn long, role string, text string")
    check(df, 32)


def test_shards_share_large_nodes(spark):
    rows = [(c, t, "user", "hi" if t < 2 else f"{c}") for c in range(2000) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    check(df, 32)
