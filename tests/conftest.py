import datetime as dt
import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

from marginkit import schema as S  # noqa: E402
from marginkit.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    ckpt = tempfile.mkdtemp(prefix="marginkit-test-ckpt-")
    s = build_session("local[*]", 8, extra={"spark.checkpoint.dir": ckpt})
    yield s


def purchase(consumer_id, day, vin=None, cycle=1, margin="100.00", model="A", year=None, age=3,
             lease=0, platform="CAR", lifestage="L1", model_year="2019", ctype="I",
             country="USA", make=S.TEST_MAKE, household="H1"):
    """One purchase row in the ownership schema; ``day`` is a date or ISO string."""
    import decimal
    d = dt.date.fromisoformat(day) if isinstance(day, str) else day
    return (
        vin or f"V{consumer_id}-{d.isoformat()}-{cycle}",
        consumer_id, cycle, model, model_year, d, year if year is not None else (d.year if d else None),
        age, lease, platform, lifestage, ctype,
        None if margin is None else decimal.Decimal(margin), country, make, household,
    )


@pytest.fixture
def make_rows(spark):
    def _make(rows, partitions=None):
        df = spark.createDataFrame(rows, S.OWNERSHIP_SCHEMA)
        return df.repartition(partitions) if partitions else df
    return _make
