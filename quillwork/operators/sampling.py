"""Even sampling of a feed over windows and categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def quota(max_rows: int, windows: int, categories: int) -> int:
    """How many rows each category of each window may have."""
    return max(1, -(-max_rows // max(1, windows * categories)))


def even_sample(df: DataFrame, by: list[str], order: list[str], per_group: int, cap: int | None = None) -> DataFrame:
    """The first ``per_group`` rows of each group; with ``cap``, the first so many of those in group order. A row in two
    groups counts in both."""
    if per_group < 1 or cap is not None and cap < 0:
        raise ValueError("per_group must be 1 or more, cap not negative")
    ranked = df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= per_group)
    return ranked if cap is None else ranked.orderBy(*by, "rank").limit(cap)
