"""Hash-sharded tables behind one logical database, on Spark."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to Python workers by value: executors need no copy of it.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
