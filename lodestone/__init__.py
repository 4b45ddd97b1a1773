"""Spark-first analytics over corpora of versioned documents.

Functions of this package that run in Python workers travel with the tasks, so executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
