import hashlib

import pytest

from marginkit.llm import decontaminate as D
from helpers import DOCS, alnum, prose, rows

ITEMS = [(0, prose(100, 30)), (1, prose(101, 13)), (2, "One two THREE, four!"), (3, None), (4, ""), (5, "..."), (6, prose(100, 30)), (7, "solo"),
         (8, "loop " * 20), (None, prose(102, 15))]
CLEAN = prose(500, 400)
TEXTS = [None, "", "?!", CLEAN, CLEAN + " " + ITEMS[0][1], ITEMS[0][1].upper(), " ".join(alnum(ITEMS[0][1])[4:16]), " ".join(alnum(ITEMS[0][1])[4:17]),
         "x one-two;three four y", "one two three", "so SOLO", "loop " * 13, "loop " * 12, "loop " * 50, CLEAN + " " + ITEMS[1][1] + " " + CLEAN, CLEAN,
         prose(102, 15) + prose(100, 30) + ITEMS[2][1], "é " + ITEMS[1][1] + "ü", " ".join(alnum(ITEMS[0][1])[:20] + alnum(ITEMS[1][1]) + alnum(ITEMS[0][1])[10:])]


def brute(text, items):
    w, hit, found = alnum(text), set(), set()
    for key, t in items:
        iw = alnum(t)
        n = min(len(iw), 13)
        windows = {tuple(iw[i:i + n]) for i in range(len(iw) - n + 1)} if iw else set()
        for i in range(len(w) - n + 1):
            if tuple(w[i:i + n]) in windows:
                hit |= set(range(i, i + n))
                found.add("null" if key is None else str(key))
    return dict(n_words=len(w), n_hit=len(hit), n_items=len(found), items_sha256=hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                contaminated=bool(hit) and 20 * len(hit) >= len(w)), hit


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)], DOCS)
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("max_words", [1_000_000, 40])
def test_counts_equal_brute_force_also_with_many_automata(tables, max_words):
    docs, bench = tables
    got = D.judge(D.find_hits(docs, bench, keep=["doc_id"], max_words=max_words)).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        want, _ = brute(TEXTS[r._row.doc_id], ITEMS)
        assert {k: r[k] for k in want} == want, (r._row.doc_id, TEXTS[r._row.doc_id])


def test_cleaned_documents(tables):
    docs, bench = tables
    out = D.decontaminate(docs.withColumnRenamed("lang", "_spans"), bench)
    assert out.columns == ["doc_id", "text", "_spans", "source", "n_chars"]
    got = {r.doc_id: r.text for r in out.collect()}
    assert set(got) == {i for i, t in enumerate(TEXTS) if not brute(t, ITEMS)[0]["contaminated"]}
    assert got[3] == CLEAN and got[0] is None and got[1] == ""
    for i, t in got.items():
        w, (_, hit) = alnum(TEXTS[i]), brute(TEXTS[i], ITEMS)
        assert alnum(t) == [x for k, x in enumerate(w) if k not in hit]
    assert 14 in got and len(alnum(got[14])) == 800


def test_automaton_lengths():
    words = [("a", "x y x y z".split()), ("b", "y x y".split())]
    sam = D.SuffixAutomaton(words, 2)
    inside = lambda run: any(run == t[i:i + len(run)] for _, t in words for i in range(len(t)))
    state = size = 0
    stream = "q x y x y x z y x y z z".split()
    for i, w in enumerate(stream):
        state, size = sam.step(state, size, sam.ids.get(w, -1))
        assert size == max([n for n in range(1, i + 2) if inside(stream[i + 1 - n:i + 1])], default=0)


def test_empty_tables(tables):
    docs, bench = tables
    assert D.decontaminate(docs.limit(0), bench).count() == 0
    assert D.decontaminate(docs, bench.limit(0)).count() == len(TEXTS)
