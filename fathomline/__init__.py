"""fathomline: panel-data building and auditing on Spark DataFrames."""

import sys

from pyspark.cloudpickle import cloudpickle

__version__ = "0.1.0"

# Functions sent to executors carry their code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
