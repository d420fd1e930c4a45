import numpy as np
import pytest

from marginkit.llm import language
from marginkit.llm.bytescan import text_chunks


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    return language.train(documents.where("doc_id % 5 <> 1"))


def test_held_out_accuracy(documents, model):
    held = documents.where("doc_id % 5 = 1").toPandas()
    import pyarrow as pa
    scores = np.concatenate([model.score(d, o)[0] for _, _, d, o in text_chunks(pa.array(held.text))])
    guess = np.array(model.languages)[scores.argmax(axis=1)]
    assert (guess == held.lang.values).mean() > 0.95


def test_trigrams_stay_inside_texts():
    import pyarrow as pa
    texts = ["abcd", "", "a", None, "xyz", "ab", "éa", "Abcd"]
    (_, _, data, offsets), = text_chunks(pa.array(texts))
    bucket, size = language.trigrams(data, offsets)
    assert list(size) == [2, 0, 0, 0, 1, 0, 1, 2] and len(bucket) == 6
    assert list(bucket[:2]) == list(bucket[-2:])


def page(text, lang=None):
    return f"<html{f' lang={lang}' if lang else ''}><body><p>{text}</p></body></html>"


def test_evidence_is_fused(spark, documents, model):
    by_lang = {r.lang: r.text[:3000] for r in documents.where("doc_id % 5 = 1").collect()}
    rows = [(i, f"http://w.site.{lang}/p{i}", page(by_lang[lang], lang), lang) for i, lang in enumerate(["de"] * 12 + ["fr"] * 12 + ["es"] * 6 + ["en"] * 6)]
    rows += [(100, "http://w.site.de/x", page("a"), "de"), (101, "http://new.site.fr/x", page(""), "fr"), (102, None, None, None), (103, "http://w.site.de/y", page("1 2 3", "fr"), None),
             (104, "http://o.org/", page("", "ES-mx"), "es"), (100, "http://w.site.de/x", page("a"), "de")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = language.identify(df, model).collect()
    assert len(got) == len(rows)
    want = {r[0]: r[3] for r in rows if r[3]}
    assert {r.page_id: r.lang for r in got if r.page_id in want} == want
    assert all(0 < r.confidence <= 1 + 1e-9 for r in got)
    none = next(r for r in got if r.page_id == 102)
    assert none.host == "" and none.declared is None and none.lang in model.languages
    assert language.identify(df.limit(0), model).count() == 0


def test_declaration_anywhere_in_the_page(spark, model):
    long = "<!-- licence " + "x " * 4000 + "-->"
    pages = {1: (long + "<html lang='de-AT'><p>a", "de"),
             2: ("<html><head><style>" + "p{} " * 3000 + "</style><meta http-equiv=Content-Language content=fr>", "fr"),
             3: ("<html><head>" + "<link rel=x href=y>" * 500 + "<meta content='ES' http-equiv='content-language'><body>a", "es"),
             4: ("<!-- <html lang=de> --><script>'<html lang=fr>'</script><html xml:lang=es>" + long, "es"),
             5: (long + "<p lang=de>a", None), 6: (long + "<html lang=''><meta name=content-language content='en, de'>", "en")}
    df = spark.createDataFrame([(k, "http://a.b/", v[0]) for k, v in pages.items()], "page_id long, url string, html string")
    assert {r.page_id: r.declared for r in language.identify(df, model).collect()} == {k: v[1] for k, v in pages.items()}


def test_host_priors_by_hand(spark):
    soft = spark.createDataFrame([("a.x", [1.0, 0.0]), ("a.x", [0.5, 0.5]), ("b.x", [0.0, 1.0]), ("", [1.0, 0.0])], "host string, p array<double>")
    got = {r._host: r for r in language.host_priors(soft, 2.0).collect()}
    root = [(2.5 + 2 * .5) / 6, (1.5 + 2 * .5) / 6]
    x = [(1.5 + 2 * root[0]) / 5, (1.5 + 2 * root[1]) / 5]
    assert [s._prior for s in got["a.x"]._prior] == pytest.approx(x) and got["a.x"]._pages == 2
    assert [s.n for s in got["a.x"]._prior] == pytest.approx([1.5, 0.5])
    assert [s._prior for s in got[""]._prior] == pytest.approx(root)


def test_training_needs_labels(documents):
    with pytest.raises(ValueError):
        language.train(documents.limit(0))
