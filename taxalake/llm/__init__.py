"""Operators for large training-data pipelines. Nothing outside this folder imports it.

Functions that run in Python workers are sent by value, so the workers need not have
this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
