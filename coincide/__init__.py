"""Event-coincidence analytics on Spark: do two event streams line up by more than chance?"""

import sys

from pyspark import cloudpickle

from coincide.params import AnalysisParams

# Functions that run in Python workers travel with their code, so that a cluster needs no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["AnalysisParams"]
