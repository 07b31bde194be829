"""fieldquarry: a PySpark-native engine for field documents, questions over them, and corpora."""

import sys

from pyspark import cloudpickle

# Executors get this package's functions with the task, so it need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
