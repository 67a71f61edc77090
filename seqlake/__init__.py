"""Ordered per-key sequences on Spark: raw records in, features, audits and retrieval out."""

import sys

from pyspark import cloudpickle

# Functions that run inside Python workers travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
