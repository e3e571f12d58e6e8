"""Spark-native analytics for investment-fund panels and training corpora.

Functions that run inside Python workers are shipped by value, so executors
need nothing of this package on their own import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
