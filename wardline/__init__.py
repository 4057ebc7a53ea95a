"""Security situational-awareness operators over Spark DataFrames."""

import sys

from pyspark import cloudpickle

from wardline.session import get_session, tune

# Python functions travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["get_session", "tune"]
