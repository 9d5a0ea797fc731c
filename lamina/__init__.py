"""A PySpark-native engine for hierarchical records and scientific text.

Functions shipped to Python workers are pickled by value: an executor needs the libraries
they use, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
