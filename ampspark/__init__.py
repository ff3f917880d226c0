"""PySpark-native engine for long-read clustering and consensus."""

import sys

from pyspark import cloudpickle

# Workers need not have the package on their path: functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
