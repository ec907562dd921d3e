"""Operators of a training-data pipeline over documents, pages and embeddings.

Each module holds one operator with its own interface; ``queries`` applies them
to the given tables. Functions that run in Python workers are shipped by value,
so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
