"""corpusloom: hybrid retrieval, incremental indexing and corpus preparation on Spark."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel by value, so that executors need no
# copy of the repository on their import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
