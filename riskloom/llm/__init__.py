"""Operators for preparing training data; nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# Functions go to the executors with their code, so that these need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
