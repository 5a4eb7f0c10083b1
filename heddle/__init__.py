"""heddle: typed ingestion, history, graph and stream operators as PySpark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
