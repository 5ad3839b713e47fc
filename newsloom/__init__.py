"""newsloom: text enrichment, entity resolution and retrieval on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions travel to the executors whole, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
