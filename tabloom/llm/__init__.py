"""Operators for preparing training text at scale.

Functions that run on executors are pickled by value, so a worker needs no
copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
