"""Operators for preparing large text corpora; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# functions and classes of this package travel to the executors by value: nothing has to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
