"""Spark-first analytics over evidence records."""

import sys

from pyspark import cloudpickle

# Functions of this package go to executors by value, so that workers need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
