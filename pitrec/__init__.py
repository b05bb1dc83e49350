"""Point-in-time recommendation analytics, expressed as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package
