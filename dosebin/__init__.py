"""Binned, control-gated, bootstrapped dose-response analytics on Spark.

Every public function takes and returns DataFrames.  Column names, group keys
and thresholds are parameters; ``schema`` holds the defaults.
"""

import sys

from pyspark import cloudpickle

# Ship the small numpy helpers with the tasks, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
