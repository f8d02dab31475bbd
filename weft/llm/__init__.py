"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions go to the executors by value: they need the third-party libraries there, but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
