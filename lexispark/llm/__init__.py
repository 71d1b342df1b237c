"""Operators for preparing training data; nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions of these modules travel to executors by value, so those need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
