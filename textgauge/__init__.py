"""Text difficulty analytics as Spark jobs."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: functions sent to tasks travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
