"""The row of each key that holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Per non-null key the columns of the row with the greatest ``order``.

    Equal orders: the greatest columns, in their order, hold; a null order ranks lowest. The maximum
    is combined on the map side, so a key delivered any number of times is no hot spot. An empty table
    gives no row.
    """
    best = F.max(F.struct(F.col(order).alias("order_"), *[F.col(c).alias(f"x_{c}") for c in columns])).alias("best_")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"best_.x_{c}").alias(c) for c in columns])
