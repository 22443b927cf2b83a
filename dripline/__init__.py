"""Household appliance usage analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Task functions travel inside the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
