"""docledger: Spark operators that turn machine-extracted invoice data into a checked ledger."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that those need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
