"""Sparse count analytics for splicing and expression data, as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so workers need no copy of it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
