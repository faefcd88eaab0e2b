"""cloakwork: sensitive-entity analytics and corpus preparation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
