"""Operators for building training data from document, page and vector tables.

One module per operator; ``queries`` registers a query per operator and ``stages`` holds the
functions of the corpus pipeline. Nothing outside this package imports it.
"""

import sys

from pyspark import cloudpickle

# Functions sent to workers take their helpers along, so executors need not have this package. What
# is broadcast must then be plain values: a broadcast names its classes instead of carrying them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
