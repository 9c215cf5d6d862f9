"""tickweave: market-data preparation expressed as Spark jobs.

Trades, quotes, depth updates and bars come in as DataFrames; bars, features,
events, labels, weights, splits and evaluation tables go out as DataFrames.
"""

__version__ = "0.1.0"

import sys

from pyspark.cloudpickle.cloudpickle import register_pickle_by_value

# Functions sent to Python workers travel whole, so the package need not be installed on the executors.
register_pickle_by_value(sys.modules[__name__])
