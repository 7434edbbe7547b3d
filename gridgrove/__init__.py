"""Hierarchical image-graph analytics as PySpark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions sent to them travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
