"""echofold: duplicate-logic analytics and text-corpus operators as Spark plans.

Functions that run on executors are shipped by value, so a cluster needs no copy of
this package beside the driver's.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
