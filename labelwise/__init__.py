"""Labelled-text data preparation, scoring and evaluation on Spark."""

import sys as _sys

__version__ = "0.1.0"

# Ship this package's functions to Python workers by value: executors then
# need no installed copy of it (closures of mapInPandas / pandas UDFs).
try:
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle
    pass
