"""Spark-native classification of mails and other short texts."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# The small Arrow functions travel to the executors by value, so a job needs no package install.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
