"""Symbol-graph analytics on Spark: relational, traversal, search, ranking, planning and incremental operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions go to Python workers with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
