"""Training-data operators: ten corpus operations over documents, vectors and conversations.

Nothing else in the library imports this package.  Functions that run in Python workers are
pickled by value, so executors need none of these modules on their own disks.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
