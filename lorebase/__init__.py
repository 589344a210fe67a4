"""Spark-native analytics for document knowledge bases."""

from pyspark import cloudpickle as _cloudpickle

import sys as _sys

# Executors get this package's functions inside the serialised task, so a job
# needs no copy of the repository on the workers' import path.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
