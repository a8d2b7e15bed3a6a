"""Operators for training-data pipelines; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Executors need not have this package: what tasks call travels with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
