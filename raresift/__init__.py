"""Imbalanced-classification and dynamic-ensemble work as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the task: executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
