"""feedloom: customer-review analytics as PySpark table operators."""

import sys

from pyspark import cloudpickle

# The small functions that run in Python workers travel with their tasks, so executors need no
# installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
