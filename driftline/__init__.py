"""driftline: knowledge-flow analytics and corpus preparation as DataFrame plans."""

import sys

from pyspark import cloudpickle

# functions travel to the Python workers with their code, so the package needn't be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
