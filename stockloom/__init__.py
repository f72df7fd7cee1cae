"""Retail demand, pricing and inventory analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors by value, so a job needs no copy of it on the workers
cloudpickle.register_pickle_by_value(sys.modules[__name__])
