"""Tries of conversations against plain dictionaries of prefixes."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quillmark.llm import prefix_trie


def brute(rows, heads=True):
    """Rows of (conv, turn, role, text) to {(smallest member, depth, parent's): the other columns}."""
    own = collections.defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 if heads else 0 for c in own}
    whole = {c: tuple(own.get(c - int(np.fmod(c, 20)), [])[: h[c]] + v[h[c] :]) for c, v in own.items()}
    members = collections.defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    return sorted(
        (m[0], len(p), members[p[:-1]][0] if p else -1, len(m), children[p], leaves[p], saved[p], hashlib.sha256(",".join(str(c) for c in m if whole[c] == p).encode()).hexdigest())
        for p, m in members.items()
    )


def got(df):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect())


def test_louds_gives_its_shape_back():
    degrees = np.array([2, 0, 3, 0, 1, 0, 0])
    louds = prefix_trie.Louds(degrees)
    assert louds.degrees().tolist() == degrees.tolist()
    assert louds.parents().tolist() == [-1, 0, 0, 2, 2, 2, 4]


@pytest.mark.parametrize("shards", [1, 3, 17])
def test_trie_equals_brute_force(spark, shards):
    rnd = random.Random(shards)
    rows = []
    for c in rnd.sample(range(-60, 400), 250):
        for t in range(rnd.randint(1, 6)):
            rows.append((c, t, rnd.choice(["user", "assistant", None]), rnd.choice(["", None, "a", "a b", "a\tb\x0bc", "é ü"])))
    hot = [("user", "same first turn"), ("assistant", "and the same answer")]
    rows += [(c, t, r, x) for c in range(500, 1400) for t, (r, x) in enumerate(hot)]  # longer lists of members than a run
    rows += [(c, 2, "user", str(c % 7)) for c in range(500, 700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    lists = prefix_trie.with_shared_heads(prefix_trie.turn_lists(df))
    assert got(prefix_trie.trie(lists, shards)) == brute(rows)


def test_edge_cases(spark):
    rows = [(None, 0, "user", "no conversation"), (1, None, "user", "null first"), (1, 0, "user", "tie"), (1, 0, "user", "eit"), (1, 0, "user", "tie"), (2, 3, None, None), (3, 3, "", ""), (4, 1, "u:", "x"), (5, 1, "u", ":x"), (6, 0, "user", "long " * 100000)]
    rows += [(7, t, "user", "deep") for t in range(200)]
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, conv int, turns string")
    lists = prefix_trie.turn_lists(df)
    assert got(prefix_trie.trie(lists, 3)) == brute(rows, heads=False)
    assert got(prefix_trie.trie(prefix_trie.with_shared_heads(lists), 2)) == brute(rows)
    assert prefix_trie.trie(prefix_trie.with_shared_heads(prefix_trie.turn_lists(df.limit(0)))).count() == 0
