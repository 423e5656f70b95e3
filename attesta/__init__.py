"""Spark-native analytics over versioned text evidence."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code: executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
