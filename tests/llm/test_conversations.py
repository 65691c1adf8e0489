"""The prefix trie against a dictionary of all beginnings, and its parentheses against plain recursion."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from compare import differences
from test_queries import folder_views

from impactrec.llm import conversations
from impactrec.llm.oracle import PREFIX_TRIE
from impactrec.llm.parentheses import Parentheses, subtree_sums
from impactrec.llm.queries import op13_prefix_trie

SCHEMA = "conv_id long, turn int, role string, text string, key string, path string, depth string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """All beginnings of all rebuilt conversations in a dictionary."""
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = set()
    for p, ids in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = {q: [r for r in members if len(r) == len(q) + 1 and r[: len(q)] == q] for q in below}
        saved = sum((len(members[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ends = ",".join(str(c) for c in sorted(ids) if len(built[c]) == len(p))
        out.add((min(ids), len(p), min(members[p[:-1]]) if p else None, len(ids), len(kids[p]), sum(not k for k in kids.values()),
                 saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def random_rows(seed, convs=90, copies=30):
    draw = random.Random(seed)
    rows = []
    for c in range(convs):
        for turn in range(draw.choice([0, 1, 2, 3, 4, 5, 30 if c == 41 else 3])):
            role = draw.choice(["user", "user", None, ""])
            text = draw.choice(["a b", "a  b c\td", "", None, "é ü", "x" * 50]) if draw.random() < 0.9 else f"t{draw.random()}"
            rows.append((c * 7 % 131, None if turn == 0 and c % 5 == 0 else turn, role, text))
    rows += [(1000 + c, t, "user", "same words here") for c in range(copies) for t in range(5)]
    rows += [(None, 1, "user", "no conversation"), (2000, 0, "user", "tie one"), (2000, 0, "user", "tie two")]
    return [(*r, "k", "p", "d") for r in rows]


@pytest.fixture(params=[1, 2, 5])
def seed(request):
    return request.param


def test_trie_matches_a_dictionary(spark, seed):
    """Shards of a few conversations each, so that spines and runs of copies go on in several."""
    rows = [r for r in random_rows(seed) if r[0] != 2000]
    turns = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), SCHEMA)
    found = conversations.prefix_trie(turns).collect()
    assert len(found) == len(set(found))
    assert {tuple(r[c] for c in COLUMNS) for r in found} == plain(rows)


def test_equal_turns_have_an_order(spark):
    rows = random_rows(3)
    one = conversations.prefix_trie(spark.createDataFrame(rows, SCHEMA))
    two = conversations.prefix_trie(spark.createDataFrame(rows[::-1], SCHEMA))
    assert sorted(one.collect(), key=str) == sorted(two.collect(), key=str)


def test_sql_on_random_rows(spark, tmp_path):
    rows = [r for r in random_rows(8) if r[0] != 2000]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert differences(op13_prefix_trie(spark, str(tmp_path)), folder_views(tmp_path), PREFIX_TRIE) is None


def test_only_turnless_conversations(spark):
    """Ids whose turns are all left out and whose family has no first one: members of the root alone."""
    ids = [c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4]
    rows = [(c, 0, "user", "gone", "", "", "") for c in ids]
    [root] = conversations.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()
    sha = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert tuple(root[c] for c in COLUMNS) == (ids[0], 0, None, len(ids), 0, 1, 0, sha)


@pytest.mark.parametrize("n", [1, 2, 3, 31, 200, 5000])
def test_parentheses(n):
    draw = np.random.default_rng(n)
    depth = np.zeros(n, np.int64)
    for i in range(1, n):
        depth[i] = draw.integers(max(1, depth[i - 1] - 3), depth[i - 1] + 2) if n != 200 else i
    ends, leaves = Parentheses(depth).subtrees()
    wide = np.append(depth, -1)
    for j in range(n):
        end = j + 1 + np.argmax(wide[j + 1 :] <= depth[j])
        assert ends[j] == end
        assert leaves[j] == np.sum(wide[j + 1 : end + 1] <= depth[j:end])
    values = draw.integers(0, 9, n)
    assert subtree_sums(values, ends).tolist() == [values[j:e].sum() for j, e in enumerate(ends)]
