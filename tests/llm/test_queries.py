"""Registered queries against their SQL, and the pipeline against its brute-force stages."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from marginkit.llm import queries, sql
from oracle_compare import duck, rows_of, spark_type_as_duck
from helpers import DOCS, folded, prose, words
from test_decontaminate import ITEMS, brute as brute_hits
from test_mixing import brute as brute_mix
from test_near_dup import classes
from test_quality import brute as brute_quality

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", list(queries.queries()))
def test_query(spark, con, key):
    df = queries.queries()[key](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if int(key[2:].split("_")[0]) <= 10:
        assert len(got) == {"pages": 50, "documents": 200}["pages" if "page_id" in df.columns else "documents"]
    assert got
    text = sql.oracle_sql().get(key)
    if text:
        res = con.execute(text)
        names = [d[0] for d in res.description]
        assert sorted(names) == sorted(df.columns)
        assert rows_of(df.columns, got) == rows_of(names, res.fetchall())
        types = dict(zip(names, (str(t) for t in con.sql(f"select * from ({text}) limit 0").types)))
        assert {f.name: spark_type_as_duck(f.dataType.simpleString()) for f in df.schema.fields} == types


def test_pipeline_equals_brute_force(spark, tmp_path):
    base = prose(1, 120)
    texts = [base, base.upper(), base + " extra words at the end.", None, "", "tiny", "spam " * 200, ITEMS[0][1], prose(70, 600) + " " + ITEMS[0][1] + " " + prose(71, 600),
             "Home | About | News\n" + prose(5, 60), prose(6, 50) + " write to jo.doe@mail.example now please."] + [prose(200 + i, 40 + i) for i in range(60)]
    docs = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    df, tables = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, str(tmp_path))
        if name != "mix_sources":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(str(tmp_path / name))
        df = spark.read.parquet(str(tmp_path / name))
        tables.append({r.doc_id: r for r in df.collect()})
    good = {i: brute_quality(t)[1] for i, t in enumerate(texts) if brute_quality(t)[0]["kept"]}
    assert {i: words(r.text) for i, r in tables[0].items()} == {i: words(t) for i, t in good.items()}
    ids = sorted(good)
    roots = {ids[c] for c in classes([good[i] for i in ids])}
    assert set(tables[1]) == roots
    clean = {i for i in roots if not brute_hits(good[i], ITEMS)[0]["contaminated"]}
    assert set(tables[2]) == clean and 8 in clean and 7 not in clean
    assert len(folded(tables[2][8].text)) < len(folded(texts[8]))
    assert set(tables[3]) == clean and "jo.doe" not in tables[3][10].text and all(r.n_chars == len(r.text) for r in tables[3].values())
    mixed = {r["doc_id"]: r["taken"] // r["size"] for r in brute_mix([(i, r.text, r.source) for i, r in tables[3].items()]) if r["taken"]}
    assert {i: r.copies for i, r in tables[4].items()} == mixed
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id: r.copies for r in whole.select("doc_id", "copies").collect()} == mixed


def test_stages_take_empty_tables_and_clashing_columns(spark):
    for name, stage in corpus_pipeline.STAGES:
        none = spark.createDataFrame([], DOCS + ", _text string, copies int, _row string")
        assert stage(spark, none, SF).count() == 0
        some = spark.createDataFrame([(1, prose(1, 50), "en", "s", 1, "a", 5, "b"), (None, None, None, None, None, None, None, None)], none.schema)
        out = stage(spark, some, SF)
        assert set(some.columns) == set(out.columns)
        assert out.where(F.col("doc_id") == 1).count() == 1
