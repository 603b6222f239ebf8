"""Operators of a training-data pipeline; nothing else in the library imports this subpackage.

Its task functions are shipped to executors by value, so these need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
