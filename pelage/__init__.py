"""Spark-native data and evaluation jobs for visual re-identification.

Every public function takes DataFrames and returns DataFrames.
"""

import sys

from pyspark import cloudpickle

# Functions that run inside Spark tasks are shipped by value, so executors
# need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
