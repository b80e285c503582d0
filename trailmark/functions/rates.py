"""The two roundings used in reports.

Shares round half away from zero, as SQL ``ROUND`` does. Funnel and bounce rates round half to
even on ``(part / whole) * 100``, in that order of operations.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share_percent(part: Column, whole: Column) -> Column:
    """part*100/whole to two decimals, NULL when there is no whole."""
    return F.round(part * F.lit(100.0) / F.nullif(whole, F.lit(0)), 2)


def rate_percent(part: Column, whole: Column) -> Column:
    """(part/whole)*100 to two decimals, half to even; 0.0 when the whole is not positive."""
    ratio = F.bround(part / F.when(whole > 0, whole) * F.lit(100.0), 2)
    return F.when(whole > 0, ratio).otherwise(F.lit(0.0))
