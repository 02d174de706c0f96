"""refsieve: a PySpark-native engine that audits bibliographic citations.

Functions that run in Python workers are shipped by value, so executors need
Spark, numpy and pyarrow, but no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
