"""Column functions on times."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_utc(seconds: Column) -> Column:
    """Epoch seconds as ISO text in UTC (the session must be in UTC)."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def clock_features(seconds: Column) -> dict[str, Column]:
    """Hour and weekday on circles, weekend and 00-05 flags (Monday is day 0)."""
    hour = F.pmod(F.floor(seconds / 3600), F.lit(24))
    day = F.pmod(F.floor(seconds / 86400) + 3, F.lit(7))
    return {
        "hour_sin": F.sin(hour * (2 * math.pi / 24)), "hour_cos": F.cos(hour * (2 * math.pi / 24)),
        "wday_sin": F.sin(day * (2 * math.pi / 7)), "wday_cos": F.cos(day * (2 * math.pi / 7)),
        "is_weekend": (day >= 5).cast("int"), "is_latenight": (hour < 5).cast("int"),
    }
