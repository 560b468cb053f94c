"""heliovox: analytics on spatial, thermal and time-series sensor data, built on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that nothing need be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
