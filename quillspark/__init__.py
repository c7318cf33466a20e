"""quillspark: document search and corpus processing as Spark plans.

Functions of this package that run on executors are pickled by value, so that
workers need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
