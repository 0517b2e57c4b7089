"""orrery: a PySpark-native analytics engine for vector geometry tables.

Geometry lives in plain Parquet tables with global ids; every operator takes and returns DataFrames and
leaves the physical strategy to Catalyst.  See README.md for the layout of the package.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# functions that run on executors travel by value, so executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
