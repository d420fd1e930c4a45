import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marginkit.llm import quality
from helpers import prose, words

LONG = prose(1, 60)
TEXTS = [
    None, "", "   \n \t\n", "short text.", LONG, LONG, LONG + "\n" + LONG,
    "\n".join([LONG] * 4), " ".join(["again"] * 200), "Home | About | News | Contact | Login\n" * 3 + prose(2, 70),
    "\n".join("NOISE!! " * 12 for _ in range(4)) + "\n" + prose(3, 30), "a### b%%% c$$$ d&&& " * 10,
    prose(4, 50) + "\nAll rights reserved. Privacy policy.\n" + prose(5, 30), " ".join(f"x{i}" for i in range(100)),
    "日本語の文。" * 5 + "\n" + " ".join(f"字{i}" for i in range(50)), "é " * 25 + "naïve ending…", prose(6, 5000, 100000),
    "same line here\nsame line here\n\n\nsame line here \nother", "|", "a\r\nb\r\na\r\n" * 10, "x\u00a0y " * 30,
]


def brute(text, r=quality.Rules()):
    t, w = text or "", words(text)
    windows = Counter(tuple(w[i:i + r.window]) for i in range(len(w) - r.window + 1))
    covered = set()
    for i in range(len(w) - r.window + 1):
        if windows[tuple(w[i:i + r.window])] > 1:
            covered |= set(range(i, i + r.window))
    lines = [x for x in t.split("\n") if words(x)]
    lost, clean = 0, []
    for line in t.split("\n"):
        lw = words(line)
        noisy = sum(bool(re.search(r"[#*$%&|<>]|!!|\?\?", x)) for x in lw)
        bars = sum(bool(re.fullmatch(r"[|>/*<-]{1,3}|[·»«•›]", x)) for x in lw)
        fails = bool(lw) and (
            100 * noisy >= r.max_symbol_rate * len(lw) or 100 * bars >= max(r.max_bar_rate * len(lw), 100)
            or (len(lw) >= r.long_line and not re.search("[.!?:;,…。、！？，：；।]", line))
            or (len(lw) <= r.boilerplate_words and any(p in line.lower() for p in quality.BOILERPLATE)))
        lost += len(lw) * fails
        if not fails:
            clean.append(line)
    n = len(w)
    base = n < r.min_words or 100 * len(covered) > r.max_repeat * n
    return dict(n_words=n, word_chars=sum(map(len, w)), n_symbols=len(re.findall("[#*$%&|<>]", t)),
                n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(covered), n_lost_words=lost,
                base_failed=base, kept=not base and 100 * lost <= r.max_loss * n), "\n".join(clean)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", i) for i, t in enumerate(TEXTS)], "doc_id long, text string, _row string, n_words long")


def test_counts_and_verdicts_equal_brute_force(docs):
    got = {r["_row"]["doc_id"]: r for r in quality.clean_lines(docs, keep=["doc_id"]).collect()}
    for i, t in enumerate(TEXTS):
        want, clean = brute(t)
        assert {k: got[i][k] for k in want} == want, t
        if t:
            kept_lines = [x for x in clean.split("\n") if words(x)]
            assert [x for x in got[i]["_clean"].split("\n") if words(x)] == kept_lines
        else:
            assert got[i]["_clean"] == t


def test_filter_keeps_columns_and_clean_documents(docs):
    out = quality.filter_quality(docs)
    assert out.columns == docs.columns
    kept = {r.doc_id: r.text for r in out.collect()}
    assert set(kept) == {i for i, t in enumerate(TEXTS) if brute(t)[0]["kept"]}
    assert kept[4] == LONG and "|" not in kept[9] and "rights reserved" not in kept[12]


def test_empty_table(docs):
    assert quality.filter_quality(docs.where(F.lit(False))).count() == 0
