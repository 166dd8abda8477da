"""sedgewren: a Spark-first engine for analysing large collections of short texts."""

import sys

from pyspark import cloudpickle

# Functions go to executors by value, so that a cluster needs no copy of the package in its workers' path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
