"""Market-data analytics expressed as Spark DataFrame and streaming jobs."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

__version__ = "0.1.0"

# Small Python helpers travel with the plan, so executors do not need this package installed.
register_pickle_by_value(sys.modules[__name__])
