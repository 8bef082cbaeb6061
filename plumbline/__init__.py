"""plumbline: exploratory data analysis declared as Spark plans."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions by value, so a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
