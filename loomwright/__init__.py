"""loomwright: a Spark-first engine for building and querying an entity knowledge base."""

import sys

from pyspark import cloudpickle

# functions travel to the executors as they are, so these need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
