"""Timeline analytics on Spark: interval algebra, salience, signal redundancy and retiming as DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers are pickled by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
