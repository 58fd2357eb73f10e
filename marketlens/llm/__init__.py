"""Operators for preparing training data: mixing, deduplication, search, filters, token output.

Functions that run inside Spark tasks are shipped by value, so executors need numpy, pandas
and Arrow, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
