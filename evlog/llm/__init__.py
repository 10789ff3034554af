"""Operators for training-data pipelines: filters, archives, deduplication, extraction, search, packing, classifiers.

Nothing else in the library imports this subpackage. Its functions are shipped to executors by value, so executors need
the Python packages these operators use, but not this repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
