"""recmill: recommender-system analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions go to the workers by value, so the package needs no installation on the executors
cloudpickle.register_pickle_by_value(sys.modules[__name__])
