"""Training-data operators: cleaning, language, WARC, HTML, near-dedup, language
model, URL rules, mixing, PII and decontamination.

Functions of this subpackage are shipped to Python workers by value, so workers
need numpy and pyarrow but not an installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
