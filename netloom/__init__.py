"""netloom: a Spark-native engine that turns drawing entities into a typed, verified infrastructure network."""

import sys

from pyspark import cloudpickle

# kernels travel to the executors by value, so that a session needs no package installed or shipped there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
