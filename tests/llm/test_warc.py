import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from marginkit.llm import warc
from helpers import rows

BIG = "<p>" + "x" * 200 + "é</p>"
PAGES = [(5, "http://a/5", BIG), (3, "http://a/3", BIG), (9, "http://a/9\r\nX: y", BIG), (1, None, "short"), (2, "u", "short"), (4, "u", None), (6, "u", ""),
         (7, "u", "WARC/1.1\r\n\r\nContent-Length: 9\r\n\r\n" * 9), (8, "u", "y" * 100_000), (None, "u", BIG), (11, "z", "z" * 99), (12, "z", "z" * 99),
         (13, "z", "z" * 100), (14, "z", "z" * 100)]


def brute():
    out = []
    for key, _, html in PAGES:
        body = (html or "").encode()
        same = [k for k, _, h in PAGES if k is not None and (h or "").encode() == body]
        again = len(body) >= 100 and key != min(same, default=key)
        out.append((key, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, _digest string").repartition(3)
    return warc.archive(pages, str(tmp_path_factory.mktemp("warc")))


def test_round_trip_equals_brute_force(spark, folder):
    got = warc.page_records(spark, folder)
    assert sorted((tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got.collect()), key=str) == brute()


def test_payloads_and_plain_files(spark, folder, tmp_path):
    want = sorted((h or "").encode() for k, _, h in PAGES if ("response" in [b[3] for b in brute() if b[0] == k]))
    assert sorted(bytes(r.payload) for r in warc.load(spark, folder).where("record_type = 'response'").collect()) == want
    for name in os.listdir(folder):
        assert name.endswith(".warc.gz")
        (tmp_path / name[:-3]).write_bytes(gzip.open(f"{folder}/{name}").read())
    again = warc.page_records(spark, str(tmp_path))
    assert again.count() == len(PAGES)


def test_filters_are_pushed_and_payloads_skipped(spark, folder):
    reader = warc.WarcReader({"path": folder})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), In(("record_id",), ("<urn:page:5>", "<urn:page:1>")), GreaterThan(("payload_length",), 3)]))
    assert left == [GreaterThan(("payload_length",), 3)]
    found = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert [r["record_id"] for r in found] == ["<urn:page:5>"]
    assert all(r.payload is None for r in warc.load(spark, folder, payload=False).collect())
    plan = warc.load(spark, folder).where("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan or "record_type" not in plan.split("Filter (")[1].split("\n")[0]


def test_partitions_follow_file_sizes(folder):
    sizes = {n: os.path.getsize(f"{folder}/{n}") for n in os.listdir(folder)}
    assert len(warc.WarcReader({"path": folder, "split_bytes": "1"}).partitions()) == len(sizes)
    assert len(warc.WarcReader({"path": folder}).partitions()) == 1


def test_empty_table_and_cut_off_archive(spark, folder, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert rows(warc.page_records(spark, warc.archive(empty, str(tmp_path / "none"))), ["page_id"]) == []
    one = next(n for n in sorted(os.listdir(folder)))
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc").write_bytes(gzip.open(f"{folder}/{one}").read()[:-10])
    with pytest.raises(Exception, match="archive ends inside"):
        warc.load(spark, str(tmp_path / "cut")).agg(F.count("*")).collect()
