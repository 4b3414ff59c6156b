"""Dataset curation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package that run inside tasks travel by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
