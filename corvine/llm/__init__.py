"""Training-data operators; nothing else in the library imports this package.

Functions of this package travel with Spark's tasks by value, so that executors
need no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
