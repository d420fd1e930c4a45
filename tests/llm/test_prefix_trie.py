"""Prefix trie against a plain version over prefixes as tuples."""

import hashlib
import zlib

import numpy as np
import pytest

from marginkit.llm import double_array, prefix_trie
from helpers import rows

TALK = "conv_id long, turn long, role string, text string"


def brute(talk, branched=True):
    own = {}
    for c, t, role, text in talk:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(x[2], x[3]) for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if branched else 0
        base = int(np.fix(c / 100)) * 100
        built[c] = tuple(own.get(base, [])[:h] + turns[h:])
    nodes = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    children = {p: 0 for p in nodes}
    for p in nodes:
        if p:
            children[p[:-1]] += 1
    leaves, saved = {p: 0 for p in nodes}, {p: 0 for p in nodes}
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1]) if p else 0
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if built[c] == p)
        out.append(dict(conv_id=min(members), depth=len(p), parent_conv_id=min(nodes[p[:-1]]) if p else None, n_convs=len(members),
                        n_children=children[p], n_leaves=leaves[p], saved_tokens=saved[p], ends=hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r["depth"], r["conv_id"]))


def found(spark, talk, branched=True, schema=TALK):
    df = prefix_trie.conversations(spark.createDataFrame(talk, schema))
    df = prefix_trie.with_common_head(df, 100, 6) if branched else df
    return rows(prefix_trie.prefix_nodes(df).drop("turn"), ["depth", "conv_id"])


def sample(n, seed=3):
    rng = np.random.default_rng(seed)
    talk = []
    for c in range(-n // 4, n):
        turns = int(rng.integers(1, 9))
        for t in range(turns):
            shared = t < 3 and c % 3
            talk.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {t if shared else (c % 7, t)} naïve 语"))
    return talk


@pytest.mark.parametrize("branched", [True, False])
def test_nodes_equal_brute_force(spark, branched):
    talk = sample(300) + [(None, 1, "user", "lost"), (700, None, None, None), (700, None, "user", ""), (700, 5, "a", "x"), (700, 5, "a", "x"),
                          (701, 1, "", "ab"), (702, 1, "a", "b"), (703, 1, "user", "long " * 200_000)]
    assert found(spark, talk, branched) == brute(talk, branched)


def test_small_shards_merge_to_the_same_nodes(spark, monkeypatch):
    talk = sample(200) + [(10_000 + c, t, "user", f"deep {t}" if t < 37 else f"own {c}") for c in range(30) for t in range(38)]
    want = brute(talk)
    for turns in (1, 7, 60):
        monkeypatch.setattr(prefix_trie, "SHARD_TURNS", turns)
        assert found(spark, talk) == want


def test_many_equal_conversations_are_hashed_in_pieces(spark):
    talk = [(c * 3, 0, "user", "hi") for c in range(5000)] + [(c * 3, 1, "user", "yes") for c in range(4000)]
    assert found(spark, talk, False) == brute(talk, False)


def test_empty_and_extra_columns(spark):
    assert found(spark, []) == []
    talk = [(1, 0, "user", "a", "x", 1), (2, 0, "user", "a", "y", 2)]
    assert found(spark, talk, False, TALK + ", key string, _h int") == brute([t[:4] for t in talk], False)
    one = spark.createDataFrame([(5, 2, None, None)], TALK)
    nodes = prefix_trie.prefix_nodes(prefix_trie.conversations(one))
    texts = {r.depth: (r.role, r.text) for r in prefix_trie.with_turns(nodes, one).collect()}
    assert texts == {0: (None, None), 1: ("", "")}


def test_double_array_holds_every_sequence_and_no_other():
    rng = np.random.default_rng(1)
    seqs = sorted({tuple(rng.integers(0, 50, rng.integers(0, 6)).tolist()) for _ in range(4000)})
    label = np.array([x for s in seqs for x in s], dtype=np.int64)
    offset = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    trie = double_array.build(label, offset)
    known = {s[:d] for s in seqs for d in range(len(s) + 1)}
    slots = {}
    for p in known:
        slot = np.zeros(1, dtype=np.int64)
        for x in p:
            slot = trie.step(slot, np.array([x]))
            assert slot[0] > 0
        slots[p] = int(slot[0])
    assert len(set(slots.values())) == len(known) == int((trie.check >= 0).sum())
    for p in list(known)[:300]:
        for x in range(50):
            assert (trie.step(np.array([slots[p]]), np.array([x]))[0] >= 0) == (p + (x,) in known)
