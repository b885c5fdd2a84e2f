"""quadspark: a PySpark-native engine for graph-shaped data."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
