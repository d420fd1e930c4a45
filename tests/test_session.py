"""Session defaults: the user's settings stay, and a cluster must name its shared folder."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

#: what this process can import, its children can
PATH = os.pathsep.join([ROOT, *[p for p in sys.path if p]])


def _run(code, submit="", **env):
    full = os.environ | {"PYTHONPATH": PATH, "PYSPARK_SUBMIT_ARGS": f"{submit} pyspark-shell"} | env
    return subprocess.run([sys.executable, "-c", code], env=full, capture_output=True, text=True, timeout=300)


def test_submitted_settings_are_kept():
    out = _run("from marginkit import build_session; s = build_session('local[1]');"
               "print('GOT', s.conf.get('spark.sql.shuffle.partitions'), s.conf.get('spark.sql.ansi.enabled'), s.conf.get('spark.sql.session.timeZone'))",
               "--conf spark.sql.shuffle.partitions=777 --conf spark.sql.ansi.enabled=false")
    assert "GOT 777 false UTC" in out.stdout, out.stderr[-2000:]


def test_cluster_without_shared_folder_is_refused():
    from marginkit import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


def test_snapshot_keys_under_another_driver_zone():
    code = """
import sys; sys.path.insert(0, 'tests')
from oracle_compare import compare, duck
from marginkit import build_session
from marginkit import catalog
from pyspark.sql import functions as F
s = build_session('local[2]', 2)
con = duck('/root/testdata/sf0.001')
for k in ('extract_snapshot', 'retail_only', 'baseline_match', 'scoring_features', 'baseline_audit', 'smape_compare'):
    r = compare(s, k, '/root/testdata/sf0.001', con)
    assert r['status'] == 'match' and r['spark_rows'] > 0, r
h = catalog._hist(s, '/root/testdata/sf0.001')
assert h.where(F.to_date('last_update_timestamp') == F.lit('2000-01-02').cast('date')).count() > 0
print('DONE')
"""
    full = os.environ | {"PYTHONPATH": PATH, "TZ": "America/New_York"}
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, env=full, capture_output=True, text=True, timeout=600)
    assert "DONE" in out.stdout, out.stderr[-2000:]


def test_scratch_is_dropped(spark):
    from marginkit.session import drop_scratch, scratch_path
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert drop_scratch(spark) >= 1
    with pytest.raises(Exception):
        spark.read.parquet(path)
