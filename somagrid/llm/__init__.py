"""Operators for preparing language-model training data.

Functions of this package travel to the executors by value, so a cluster only
needs the library on the driver.  Nothing else in the library imports it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
