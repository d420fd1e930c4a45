"""Spelling variants against brute force over all pairs of words."""

import itertools
import re
import zlib

import numpy as np
import pytest

from marginkit.llm import queries, spelling
from marginkit.llm.fm_index import Vocabulary
from helpers import DOCS, FOLD, rows


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def brute(counts, ratio=10):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append(dict(word=w, form=form[w], root=root, n=counts[w], n_near=len(near[w]), form_n=counts[form[w]] if form[w] else None))
    return sorted(out, key=lambda r: r["word"])


def family(seed, n, letters="abcé", low=7, high=10):
    rng = np.random.default_rng(seed)
    out = {}
    for _ in range(n):
        w = "".join(rng.choice(list(letters), rng.integers(low, high)))
        out[w] = int(rng.choice([2, 3, 25, 40, 400, 5000]))
        for _ in range(2):
            at, kind = int(rng.integers(0, len(w))), rng.integers(0, 3)
            v = [w[:at] + w[at + 1:], w[:at] + "z" + w[at + 1:], w[:at] + w[at] + w[at:]][kind]
            if len(v) >= low:
                out.setdefault(v, int(rng.integers(2, 60)))
    return out


def found(spark, counts):
    return rows(spelling.variant_groups(spark.createDataFrame(list(counts.items()), "word string, n long")), ["word"])


@pytest.mark.parametrize("letters", ["ab", "abcé", "abcdefghijÿxß"])
def test_search_finds_every_pair_once(letters):
    words = sorted(family(len(letters), 250, letters))
    index = Vocabulary(words)
    for suffix in (False, True):
        who, hit = index.one_error(words, np.ones(len(words), dtype=bool), suffix)
        got = list(zip(who.tolist(), hit.tolist()))
        assert len(got) == len(set(got))
        want = set()
        for (i, q), (j, w) in itertools.permutations(enumerate(words), 2):
            same = q[len(q) // 2:] if suffix else q[:len(q) // 2]
            if one_edit(q, w) and (w.endswith(same) if suffix else w.startswith(same)):
                want.add((i, j))
        assert set(got) == want


def test_groups_equal_brute_force(spark):
    counts = family(5, 300) | {"colour": 50, "aaaaaaa": 3, "aaaaaaaa": 60, "aaaaaaaaa": 700, "ünïcodé×÷": 4, "ünïcode×÷": 400}
    assert found(spark, counts) == brute(counts)


def test_a_hot_half_is_cut_in_blocks(spark, monkeypatch):
    counts = {"commonprefix" + w: n for w, n in family(6, 120, "abc", 8, 9).items()} | {w + "ending": n for w, n in family(7, 60, "abc", 4, 6).items()}
    want = brute(counts)
    monkeypatch.setattr(spelling, "SHARD_WORDS", 40)
    assert found(spark, counts) == want


def test_chains_ties_repeats_and_nulls(spark):
    chain = {"aaaaaaab": 2, "aaaaaabb": 20, "aaaaabbb": 200, "aaaabbbb": 2000, "aaabbbbb": 20000, "zzzzzzza": 30, "zzzzzzzb": 30, "zzzzzzz": 3}
    got = found(spark, chain)
    assert got == brute(chain) and got[0]["root"] == "aaabbbbb"
    assert [r["form"] for r in got if r["word"] == "zzzzzzz"] == ["zzzzzzza"]
    twice = spark.createDataFrame([("wordword", 2, 1), ("wordword", 3, 2), (None, 4, 3)], "word string, n long, form int")
    assert rows(spelling.variant_groups(twice), ["word"]) == [dict(word="wordword", form=None, root="wordword", n=5, n_near=0, form_n=None)]
    assert spelling.variant_groups(twice.where("false")).count() == 0


def test_query_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(2)
    stems = ["Étrangement", "variation", "Grouping", "ZEBRAÀzebra", "tokenizer", "naïveté", "pipelines", "short", "x" * 3000]
    docs = [(i, " ".join(str(rng.choice(stems)) + str(rng.choice([" ", ".", "1", "\n", "-"])) for _ in range(60)), "en", "s", 1) for i in range(120)]
    docs += [(500, None, "en", "s", 1), (501, "", "en", "s", 1), (None, "variation variation", "en", "s", 1), (7, "variation " * 3, "en", "s", 1)]
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    counts = {}
    for i, text, *_ in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 7:
                counts[run] = counts.get(run, 0) + 1
    want = brute({w: n for w, n in counts.items() if n >= 2})
    assert any(r["form"] for r in want)
    assert rows(queries.op11_spelling(spark, str(tmp_path)), ["word"]) == want
