"""Corpus indexing, retrieval and conversation analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Batch functions travel to the executors by value, so a cluster needs no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
