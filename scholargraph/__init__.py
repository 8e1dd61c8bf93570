"""scholargraph: scholarly-corpus analytics and training-data preparation on PySpark.

Functions that run in Python workers are shipped by value, so an application that only has this package on the
driver's path needs no extra files on the executors.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
