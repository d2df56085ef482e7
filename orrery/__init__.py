"""Orrery: a Spark-native engine for entity, idea and text analytics."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors whole, so that it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
