"""folio: document analytics on Spark.

Operators are functions from DataFrames to DataFrames. Functions that run inside
Python tasks are shipped by value, so executors need no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
