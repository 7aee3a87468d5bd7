"""Self-service KPI reporting as Spark DataFrame operators."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Python functions of this package travel inside the job, so executors need no installation.
register_pickle_by_value(sys.modules[__name__])
