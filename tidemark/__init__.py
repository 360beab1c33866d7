"""Tidemark: organisational-memory and activity analytics as PySpark DataFrame queries."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Workers then need no copy of the package on their path: functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
