"""railbird: hand-history analytics as plain Spark DataFrame functions.

Every operator takes DataFrames and explicit parameters and returns a
DataFrame; nothing here collects data, reads the clock or owns a session.
"""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Rules and small helpers travel to the executors inside the tasks that use
# them, so the package need not be installed there.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
