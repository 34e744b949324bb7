"""Operators of a training-data pipeline over ``documents`` and ``embeddings``.

One module per operator. Nothing else in the library imports this package. Its
functions travel with the tasks that run them, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
