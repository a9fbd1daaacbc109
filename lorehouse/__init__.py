"""Document-knowledge analytics on Spark: every public function maps DataFrames to DataFrames."""

import sys

from pyspark import cloudpickle

# Arrow functions travel to the executors by value, which then need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
