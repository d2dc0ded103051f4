"""crawlens: audits of stored web crawls and training-data operators as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their plan: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
