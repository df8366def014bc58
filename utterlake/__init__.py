"""Spark-native analytics over layered, utterance-level text corpora."""

import sys

from pyspark import cloudpickle

# Worker functions travel with the task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
