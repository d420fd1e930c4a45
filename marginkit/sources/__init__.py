"""Sources and sinks: table scans, the test-table adapter and the extracts."""

from .adapter import ownership, ownership_history  # noqa: F401
from .extract import extract_outcome, extract_ownership, extract_snapshot, write_history  # noqa: F401
from .tables import bad_cohort_rows, read_cohort_csv, read_table, write_csv, write_table  # noqa: F401
