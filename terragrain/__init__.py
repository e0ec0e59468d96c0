"""Spark-native raster and vector analytics.

Functions that run in Python workers are shipped by value, so executors need
Spark and the listed libraries only, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
