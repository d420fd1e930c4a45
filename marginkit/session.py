"""Spark session defaults and the shared scratch location.

Nothing here is required by the operators: they take and return DataFrames and
work on any session. These helpers supply defaults for settings the user left open
(AQE with skew-join splitting, UTC, ANSI) and resolve the folder used to cut
lineage, which on a cluster must be the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings the library is tuned for. They are defaults only: whatever the user has set
# (spark-submit --conf, spark-defaults, the builder) stays. AQE re-plans joins from
# runtime sizes, splits skewed shuffle partitions and coalesces small ones;
# forceOptimizeSkewedJoin lets it split a hot consumer_id even when a later aggregate
# then needs a re-shuffle.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
# Only where this function starts a local session itself; these cannot be set later.
LOCAL_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}
_scratch: list[str] = []


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "marginkit", extra: dict | None = None) -> SparkSession:
    """Create (or reuse) a session with the library defaults.

    ``master=None`` leaves the master to spark-submit. ``shuffle_partitions`` is set only
    if given; without it Spark's own setting counts, so size
    ``spark.sql.shuffle.partitions`` at submit time (one partition ~128-256 MB of shuffle
    data). ``extra`` is set as given.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        if _is_local(master):
            for key, value in LOCAL_CONF.items():
                builder = builder.config(key, value)
    given = dict(extra or {})
    if shuffle_partitions is not None:
        given["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in given.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    already = spark.conf.getAll
    for key, value in DEFAULT_CONF.items():
        if key not in already:
            spark.conf.set(key, value)
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    A cluster names it in ``spark.checkpoint.dir``; that value is always used as is, and
    without it a cluster session is refused, as executors could not share a local folder.
    Only a local master (tests, a laptop) gets a fresh folder under the system temp dir,
    deleted when Python ends.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not _is_local(sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="marginkit-ckpt-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-path of the shared checkpoint folder for an intermediate table."""
    path = os.path.join(ensure_checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")
    _scratch.append(path)
    return path


def drop_scratch(spark: SparkSession) -> int:
    """Delete the intermediate tables this process has named so far; for the end of a job,
    when no DataFrame built on them is used any more. Returns how many were there."""
    hadoop, found = spark.sparkContext._jvm.org.apache.hadoop.fs, 0
    while _scratch:
        path = hadoop.Path(_scratch.pop())
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found += bool(fs.delete(path, True))
    return found
