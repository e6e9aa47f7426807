"""tesseral: typed tensors and text corpora as DataFrames.

The package is shipped to Python workers by value, so a cluster needs no
installation of it beside the driver's.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
