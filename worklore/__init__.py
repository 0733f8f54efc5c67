"""Work-history analytics on PySpark.

Functions of this package that run on executors travel by value, so executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
