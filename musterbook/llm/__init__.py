"""Operators on training text: quality, duplicates, mixing, language, secrets, URLs, chat."""

import sys

from pyspark import cloudpickle

# Functions for Arrow batches travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
