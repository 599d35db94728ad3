"""A Spark-native engine for moving, shaping and analysing tabular data."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers go out by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
