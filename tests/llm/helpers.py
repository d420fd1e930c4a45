"""Plain Python versions of the word rules, shared by the tests."""

import re

FOLD = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def folded(text):
    return words((text or "").translate(FOLD))


def alnum(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(FOLD))


def rows(df, key):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: tuple((r[k] is not None, r[k]) for k in key))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n, vocabulary=60):
    """n deterministic words with sentence ends."""
    x, out = seed * 7919 + 13, []
    for i in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        w = "w" + "abcdefghij"[x % 10] + str(x // 10 % vocabulary)
        out.append(w + ("." if i % 9 == 8 else ""))
    return " ".join(out) + "."
