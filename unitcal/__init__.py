"""Forecast, calibrate and audit event-grouped series on Spark.

Every public operator takes DataFrames plus keyword arguments and returns a
DataFrame.  The roles of the input columns are named by :class:`SeriesSpec`.
"""

import sys

from pyspark import cloudpickle

from unitcal.roles import SeriesSpec

# Helpers used inside pandas UDFs travel with the UDF, so the Python workers need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["SeriesSpec"]
