"""marginkit: customer margin analytics as Spark DataFrame operators.

Layout: ``sources`` (scans, sinks, extracts, test-table adapter), ``functions``
(column expressions), ``operators`` (DataFrame -> DataFrame steps), ``plans``
(composite flows), ``catalog`` (registered queries), ``llm`` (training-data operators,
optional: nothing else here imports it).
"""

from . import schema  # noqa: F401
from .session import build_session, ensure_checkpoint_dir  # noqa: F401
