"""Low-rank matrix factorization of rating tables, expressed as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value: executors need numpy and pyarrow
# only, not an installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
