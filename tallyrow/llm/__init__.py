"""Operators for training-data pipelines over document and page tables.

Functions of this package are sent to the Python workers by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
