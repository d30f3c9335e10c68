"""wattsift: Spark jobs for quality-per-joule-second analysis of model executions."""

import sys

from pyspark import cloudpickle

# Python workers get the package's functions with the task, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
