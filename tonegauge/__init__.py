"""tonegauge: a Spark-native engine for evaluating how well rewrites follow numeric style requests.

Every operator is a function over Spark DataFrames / Columns.  Text generation and
judging stay outside: responses and verdicts arrive as input tables.
"""

import sys

from tonegauge.schema import DEFAULT_GOALS  # noqa: F401

# Python UDFs defined here travel to executors by value, so executors need no install of this
# package (cluster or local workers alike).
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass

__version__ = "0.1.0"
