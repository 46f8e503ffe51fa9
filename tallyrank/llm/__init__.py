"""Operators for training-data pipelines. Nothing else in the library imports this.

Functions that run inside Python tasks travel to the executors by value, so a
cluster needs this package on the driver only.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
