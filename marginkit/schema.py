"""Data model: the ownership schema, extract specifications and the calendar.

One ``ExtractSpec`` captures everything that differs between the extracts of the
training, scoring and baseline flows (country, make, date window, which columns
must be non-null, retail only). One ``Calendar`` holds the dates of a flow, so the
same operators run on any period.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

# Column names of the purchase (ownership) table.
VIN = "vin"
CUSTOMER = "consumer_id"
CYCLE = "vehicle_ownership_cycle_num"
MODEL = "vehicle_model"
MODEL_YEAR = "vehicle_model_year"
DATE = "acquisition_date"
YEAR = "acquisition_year"
AGE = "vehicle_age"
LEASE = "fmcc_lease_purchase_ind"
PLATFORM = "platform"
LIFESTAGE = "lifestage_value"
CUSTOMER_TYPE = "consumer_type_code"
MARGIN = "contribution_margin"
COUNTRY = "country_code"
MAKE = "vehicle_make"
HOUSEHOLD = "household_demogrphics_key"  # spelling as in the source table
SNAPSHOT_TS = "last_update_timestamp"

OWNERSHIP_SCHEMA = T.StructType([
    T.StructField(VIN, T.StringType()),
    T.StructField(CUSTOMER, T.LongType()),
    T.StructField(CYCLE, T.IntegerType()),
    T.StructField(MODEL, T.StringType()),
    T.StructField(MODEL_YEAR, T.StringType()),
    T.StructField(DATE, T.DateType()),
    T.StructField(YEAR, T.IntegerType()),
    T.StructField(AGE, T.IntegerType()),
    T.StructField(LEASE, T.IntegerType()),
    T.StructField(PLATFORM, T.StringType()),
    T.StructField(LIFESTAGE, T.StringType()),
    T.StructField(CUSTOMER_TYPE, T.StringType()),
    T.StructField(MARGIN, T.DecimalType(18, 2)),
    T.StructField(COUNTRY, T.StringType()),
    T.StructField(MAKE, T.StringType()),
    T.StructField(HOUSEHOLD, T.StringType()),
])

HISTORY_SCHEMA = T.StructType(OWNERSHIP_SCHEMA.fields + [T.StructField(SNAPSHOT_TS, T.TimestampType())])

# Columns carried by a cleaned purchase row (the extract projection).
PURCHASE_COLUMNS = [VIN, CUSTOMER, CYCLE, MODEL, MODEL_YEAR, DATE, YEAR, AGE, LEASE,
                    PLATFORM, LIFESTAGE, MARGIN]

MARGIN_TYPE = T.DecimalType(18, 2)
RETAIL_CODE = "I"
NEW_VEHICLE_CYCLE = 1


@dataclass(frozen=True)
class ExtractSpec:
    """Filter of one extract over the purchase table.

    ``start``/``end`` are inclusive ``date`` bounds (``None`` = open). The
    ``require_*`` flags add ``IS NOT NULL`` tests; ``nonzero_margin`` keeps only
    known margins (outcome extracts); ``retail_only`` keeps individual buyers.
    ``extra_columns`` are carried beyond the purchase projection.
    """

    country: str
    make: str
    start: dt.date | None = None
    end: dt.date | None = None
    require_household: bool = False
    require_margin: bool = False
    require_model: bool = False
    nonzero_margin: bool = False
    retail_only: bool = False
    extra_columns: tuple[str, ...] = ()

    def with_(self, **changes) -> "ExtractSpec":
        return replace(self, **changes)


@dataclass(frozen=True)
class Calendar:
    """Dates of one flow.

    ``history_start``/``history_end``: purchase window of the features.
    ``cut``: train rows are on or before it, test rows after it.
    ``snapshot``: day of the history snapshot used by the scoring flows.
    ``outcome_start``: first day of the outcome (target) window.
    ``recent_start``/``recent_end``: window of the fallback mean of the baseline.
    """

    history_start: dt.date
    history_end: dt.date
    cut: dt.date
    snapshot: dt.date
    snapshot_history_end: dt.date
    outcome_start: dt.date
    recent_start: dt.date
    recent_end: dt.date


# The reference periods (2003-2021 history, 2017-12-31 cut, snapshot of
# 2022-01-02, outcomes from 2022-01-01, recent year 2021) mapped onto the span of the
# test tables (orders from 1995-01-01 to 2001-08-01).
TEST_CALENDAR = Calendar(
    history_start=dt.date(1995, 1, 1),
    history_end=dt.date(2001, 12, 31),
    cut=dt.date(1999, 12, 31),
    snapshot=dt.date(2000, 1, 2),
    snapshot_history_end=dt.date(1999, 12, 31),
    outcome_start=dt.date(2000, 1, 1),
    recent_start=dt.date(1999, 1, 1),
    recent_end=dt.date(1999, 12, 31),
)

# Country codes, the make of the test tables, and the fallback margins
# the incumbent model hard-codes per country.
COUNTRY_US = "USA"
COUNTRY_SECOND = "CAN"
TEST_MAKE = "MAKE_A"
FALLBACK_MARGIN_US = "13591.790626"
FALLBACK_MARGIN_SECOND = "10708.813996"


@dataclass(frozen=True)
class Flow:
    """A country flow: its extracts, derived from one country and calendar."""

    country: str
    make: str = TEST_MAKE
    calendar: Calendar = field(default=TEST_CALENDAR)
    household_required: bool = True

    def training_extract(self) -> ExtractSpec:
        c = self.calendar
        return ExtractSpec(self.country, self.make, c.history_start, c.history_end,
                           require_household=self.household_required, require_margin=True,
                           require_model=True)

    def all_customers_extract(self) -> ExtractSpec:
        return ExtractSpec(self.country, self.make, require_model=True)

    def snapshot_extract(self) -> ExtractSpec:
        c = self.calendar
        return ExtractSpec(self.country, self.make, c.history_start, c.snapshot_history_end,
                           require_household=self.household_required,
                           extra_columns=(CUSTOMER_TYPE,))

    def outcome_extract(self) -> ExtractSpec:
        c = self.calendar
        return ExtractSpec(self.country, self.make, c.outcome_start, None, require_margin=True,
                           nonzero_margin=True, retail_only=True, extra_columns=(CUSTOMER_TYPE,))


US_FLOW = Flow(COUNTRY_US)
SECOND_FLOW = Flow(COUNTRY_SECOND, household_required=False)
