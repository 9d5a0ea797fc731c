"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it, so it can be removed whole. The
functions shipped to Python workers are pickled by value: an executor needs the
libraries they use, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
