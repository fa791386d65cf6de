"""Exertion analytics for recorded strength sets, written as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# The few Python functions that run inside tasks travel with the task, so that
# executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
