"""Spark-native risk analytics: binning, stability, selection, scorecards and monitoring."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions go to the executors with their code, so that these need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
