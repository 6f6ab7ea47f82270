"""Raster, landform and corpus analytics expressed as PySpark plans."""

import sys

from pyspark import cloudpickle

# Executors need not have this package on their path: functions travel by value, and what is broadcast is plain data.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
