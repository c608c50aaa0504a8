"""Account targeting and corpus preparation as Spark operators: DataFrames in, DataFrames out."""

import sys

from pyspark import cloudpickle

#: Functions of this package that run inside Spark tasks travel with the task, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
