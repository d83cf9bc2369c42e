"""chronocore: temporal core analytics on Spark DataFrames."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so the executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
