"""Spatial cell-map analytics on Spark DataFrames."""

from somagrid.session import build_session, checkpoint_root, cut, spread

__all__ = ["build_session", "checkpoint_root", "cut", "spread"]

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors by value, so a cluster needs the library on the driver only
cloudpickle.register_pickle_by_value(sys.modules[__name__])
