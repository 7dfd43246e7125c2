"""Panel analytics, tree regression and resampling statistics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with the job, so executors need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
