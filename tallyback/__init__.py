"""Retail returns and retention analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Ship the package's own helper functions inside pandas UDFs by value, so a job
# works on executors that do not have the package on their Python path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
