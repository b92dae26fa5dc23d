"""One arithmetic for two engines: the impurities are written once over Spark columns and numpy arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F


class SparkOps:
    log = staticmethod(F.log)
    exp = staticmethod(F.exp)
    absolute = staticmethod(F.abs)

    @staticmethod
    def where(test, a, b):
        return F.when(test, a).otherwise(b)

    @staticmethod
    def most(*x):
        return F.greatest(*[F.lit(v) if isinstance(v, (int, float)) else v for v in x]) if len(x) > 1 else x[0]


class NumpyOps:
    log = staticmethod(np.log)
    exp = staticmethod(np.exp)
    absolute = staticmethod(np.abs)

    @staticmethod
    def where(test, a, b):
        return np.where(test, a, b)

    @staticmethod
    def most(*x):
        return np.maximum.reduce(np.broadcast_arrays(*x))

