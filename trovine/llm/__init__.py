"""Operators for preparing training data: ten of them, one module each, and their registered queries in ``queries``."""

import sys

from pyspark import cloudpickle

# Functions of this package go to the Python workers by value: a cluster needs no copy of the library installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
