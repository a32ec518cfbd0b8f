"""tickloom: Spark-native operators for time-stamped panel data."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with their job, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
