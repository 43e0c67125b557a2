"""Learning from skewed class distributions, as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# task functions travel inside the job, so executors do not need this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
