"""Spark jobs that prepare and score image-and-dialogue training data."""

import sys

from pyspark import cloudpickle

# Functions travel with their tasks, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
