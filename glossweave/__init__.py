"""Spark-native analytics over multilingual word data.

Every query operator takes a *table* of requests and answers it in one job.
"""

import sys

from pyspark import cloudpickle

# Python functions of this package travel by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
