"""The registered queries and their SQL counterparts, by area."""

import sys

from pyspark import cloudpickle

from . import correlations, distributions, missing, outliers, sources, statistics  # noqa: F401
from .base import ORACLE, QUERIES  # noqa: F401

cloudpickle.register_pickle_by_value(sys.modules[__name__])
