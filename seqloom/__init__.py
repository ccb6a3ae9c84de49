"""Spark-first analytics over immune-receptor sequence tables."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions of this package travel to the executors by value, so the workers
# need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
