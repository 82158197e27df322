"""Exact medians of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def medians(df: DataFrame, by: str, value: str, name: str = "median") -> DataFrame:
    """(``by``, ``name``): the median of ``value`` in each group, the mean of the middle two where their number is even; groups without values have none.

    Values are counted on the map side first, so that what one task sorts are a group's distinct values with their counts, not its
    rows. Nulls are left out.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("_by"), F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    order = Window.partitionBy("_by").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumn("_to", F.sum("_c").over(order)).withColumn("_n", F.sum("_c").over(Window.partitionBy("_by")))
    low, high = F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)  # places of the middle two, from 0
    holds = lambda place: (F.col("_to") - F.col("_c") <= place) & (place < F.col("_to"))
    middle = placed.groupBy("_by").agg(((F.max(F.when(holds(low), F.col("_v"))) + F.max(F.when(holds(high), F.col("_v")))) / 2).alias(name))
    return middle.withColumnRenamed("_by", by)
