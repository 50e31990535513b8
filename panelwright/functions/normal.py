"""Normal distribution functions, which Spark lacks. Applied to result tables of a few rows."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_NORMAL = NormalDist()


@F.pandas_udf(DoubleType())
def normal_cdf(x: pd.Series) -> pd.Series:
    return x.map(_NORMAL.cdf, na_action="ignore")


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    return p.map(lambda v: _NORMAL.inv_cdf(v) if 0 < v < 1 else float("nan"), na_action="ignore")


@F.pandas_udf(DoubleType())
def erfc(x: pd.Series) -> pd.Series:
    return x.map(math.erfc, na_action="ignore")
