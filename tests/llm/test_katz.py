import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginkit.llm import katz
from helpers import folded, prose


class Brute:
    def __init__(self, texts):
        self.uni, self.bi = Counter(), Counter()
        for t in texts:
            self.uni.update(t)
            self.bi.update(zip(["<s>"] + t[:-1], t))
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        counts = lambda c: [Counter(c.values())[r] for r in range(1, katz.GT_MAX + 2)]
        self.d1, self.d2 = katz.discounts(counts(self.uni)), katz.discounts(counts(self.bi))
        self.unknown = self.n - sum(self.w(self.d1, c) for c in self.uni.values())
        self.scale = 1
        if self.unknown < 0.5:
            self.scale, self.unknown = self.n / (self.n + 1) * self.n / (self.n - self.unknown), self.n / (self.n + 1)
        self.c, self.left, self.seen = Counter(), Counter(), Counter()
        for (h, w), c in self.bi.items():
            self.c[h] += c
            self.left[h] += c - self.w(self.d2, c)
            self.seen[h] += self.p1(w)

    def w(self, d, c):
        return d[c] * c if c <= katz.GT_MAX else c

    def p1(self, w):
        return (self.scale * self.w(self.d1, self.uni[w]) if w in self.uni else self.unknown) / self.n

    def p(self, h, w):
        if not self.c[h]:
            return self.p1(w)
        left, scale = self.left[h] / self.c[h], 1
        if left <= 0:
            scale, left = self.c[h] / (self.c[h] + 1), 1 / (self.c[h] + 1)
        r = self.bi.get((h, w), 0)
        return self.w(self.d2, r) / self.c[h] * scale if r else left / (1 - self.seen[h]) * self.p1(w)


TEXTS = [prose(i, 40 + i % 60, 12) for i in range(160)] + [None, "", "A a A b", "only unknown words xx yy zz", prose(400, 4000, 200), "w " * 500]


@pytest.mark.parametrize("batch,bucket,hot", [(10**6, 10**6, 1024), (700, 900, 4), (300, 500, 1)])
def test_scores_equal_brute_force(spark, monkeypatch, batch, bucket, hot):
    for name, value in (("BATCH_TOKENS", batch), ("BUCKET_TOKENS", bucket), ("HOT", hot)):
        monkeypatch.setattr(katz, name, value)
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(TEXTS))]
    tokens = [folded(t) + ["</s>"] for t in TEXTS]
    m = Brute([t for t, h in zip(tokens, held) if not h])
    for h in ["<s>", "w", tokens[0][0], "never seen"]:
        assert sum(m.p(h, w) for w in m.uni) + m.p(h, "\0") == pytest.approx(1, abs=1e-9)
    df = spark.createDataFrame([(i, h, t, 1) for i, (h, t) in enumerate(zip(held, TEXTS))], "doc_id long, held_out boolean, text string, n int")
    got = {r.doc_id: r for r in katz.score_corpus(df.repartition(3)).collect()}
    assert len(got) == len(TEXTS) and any(held)
    for i, t in enumerate(tokens):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(w in m.uni for w in t), m.n)
        assert r.base_score == pytest.approx(sum(math.log10((m.uni[w] + 0.5) / (m.n + 0.5 * (m.v + 1))) for w in t))
        assert r.score == pytest.approx(sum(math.log10(m.p(h, w)) for h, w in zip(["<s>"] + t[:-1], t)), abs=1e-7)


def test_repeated_rows_null_ids_and_no_training_texts(spark):
    df = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, None)], "doc_id long, text string")
    got = katz.score_corpus(df.withColumn("held_out", F.lit(False))).collect()
    assert len(got) == 3 and sorted(r.n_tokens for r in got) == [1, 3, 3] and all(r.score < 0 for r in got)
    none = katz.score_corpus(df.withColumn("held_out", F.lit(True))).collect()
    assert len(none) == 3 and all(r.score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in none)
    assert katz.score_corpus(df.withColumn("held_out", F.lit(False)).limit(0)).count() == 0


def test_packing_and_discounts():
    for values in ([], [0], [255], [256, 1], [2**40, 3, 0]):
        assert list(katz.unpack(katz.pack(np.array(values, dtype=np.int64)))) == values
    assert all(0 < x < 1 for x in katz.discounts([100, 40, 20, 12, 8, 5])[1:])
    for odd in ([0] * 6, [5, 0, 0, 0, 0, 0], [1, 9, 9, 9, 9, 9], [0, 3, 0, 2, 0, 0]):
        assert all(0 < x < 1 for x in katz.discounts(odd)[1:])


def test_unknown_words_after_frequent_ones_only(spark):
    texts = ["a b a b"] * 6 + ["a c", "zz", ""]
    m = Brute([folded(t) + ["</s>"] for t in texts[:6]])
    assert sum(m.p1(w) for w in m.uni) + m.p1("\0") == pytest.approx(1, abs=1e-12)
    df = spark.createDataFrame([(i, i >= 6, t) for i, t in enumerate(texts)], "doc_id long, held_out boolean, text string")
    for r in katz.score_corpus(df).collect():
        t = folded(texts[r.doc_id]) + ["</s>"]
        assert math.isfinite(r.score)
        assert r.score == pytest.approx(sum(math.log10(m.p(h, w)) for h, w in zip(["<s>"] + t[:-1], t)), abs=1e-9)
