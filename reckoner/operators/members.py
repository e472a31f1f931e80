"""Members of groups: whole ones stay a table, shown ones are a few."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_SHOWN = 12


def shown(rows: DataFrame, by: list[str], col: str, name: str, most: int | None = MOST_SHOWN) -> DataFrame:
    """The first `most` values of each group, in order, as an array, or all of them. Tasks keep only their own first ones before the shuffle, so no group is gathered unless all are asked for."""
    if most is None:
        return rows.groupBy(*by).agg(F.sort_array(F.collect_list(col)).alias(name))
    nth = F.row_number().over(Window.partitionBy(*by).orderBy(col))
    few = rows.select(*by, col).withColumn("nth", nth).filter(F.col("nth") <= most)
    return few.groupBy(*by).agg(F.sort_array(F.collect_list(col)).alias(name))
