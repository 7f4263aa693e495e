"""Operators of a training-data pipeline; nothing outside this package imports it.

Functions that run inside tasks are pickled by value, so executors need numpy and
pyarrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
