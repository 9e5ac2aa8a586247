"""Operators of a training-data pipeline, with their queries (``queries.py``).

Nothing outside this folder imports it. Functions sent to executors are pickled by value, so that
the workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
