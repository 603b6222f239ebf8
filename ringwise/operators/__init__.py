"""Operators over the fraud tables.  Task functions are shipped by value: executors need not have the package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
