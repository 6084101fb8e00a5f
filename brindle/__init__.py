"""Spark-native analytics for software-architecture evidence and review data."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors by value: they need no installation there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
