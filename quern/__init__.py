"""quern: document memory, retrieval and training-data operators expressed as Spark plans."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions of this package travel to the executors by value, so that it need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
