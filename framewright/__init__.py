"""Frame-level sequence tables, speaker pools, span edits and evaluation on Spark."""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel by value, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
