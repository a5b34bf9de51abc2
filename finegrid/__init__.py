"""Spark analytics for coarse-to-fine weather and agronomy tables.

Every operator is a function from DataFrames to a DataFrame; see README.md for
the map from operator to module.
"""

import sys

from pyspark import cloudpickle

# functions of this package travel inside the task, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
