"""Motion-sensor analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors with their code, so nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
