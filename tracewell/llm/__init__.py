"""Operators that prepare text corpora for model training."""

import sys

from pyspark import cloudpickle

# functions sent to executors carry their code, so that executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
