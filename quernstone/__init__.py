"""Table jobs on Spark for data-quality investigation and knowledge-base search."""

import sys

from pyspark import cloudpickle

# Batch functions travel inside their tasks, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
