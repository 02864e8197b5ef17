"""Operators for preparing training text; nothing else in the library imports this package.

Functions that run in tasks travel to the executors by value: they need not have this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
