"""Path queries over nested records, compiled to Spark Columns and DataFrames.

The package's functions travel to Python workers by value, so that the workers
need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
