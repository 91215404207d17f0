"""refaudit - citation and evidence audit on Spark.

Bibliographies, manuscripts, catalog dumps, web pages and request logs are plain
DataFrames; every operator maps DataFrames (or Columns) to DataFrames (or Columns)
and leaves partitioning, join strategy and spilling to Catalyst and AQE.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# The few Arrow functions travel by value, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
