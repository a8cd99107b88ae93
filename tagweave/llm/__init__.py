"""Operators of a training-data pipeline over documents, pages and conversations.

Nothing outside this package imports it. Task code is pickled by value, so executors
need the third-party libraries but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
