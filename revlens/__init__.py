"""Review-sentiment analytics written as Spark DataFrame, SQL and MLlib jobs."""

import sys

from pyspark import cloudpickle

# Arrow functions travel to the Python workers with their helpers, so the
# package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
