"""Sorted, keyed, derived datasets under incremental updates, on Spark."""

import sys

from pyspark import cloudpickle

# functions for Python workers travel with their code: executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
