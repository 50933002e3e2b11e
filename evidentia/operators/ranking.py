"""How far the best candidate is ahead, and whether others compete with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tie_gap(rows: DataFrame, group: str, score: str) -> DataFrame:
    """Per group: best score and its lead over the runner-up, null if there is none."""
    w = Window.partitionBy(group).orderBy(F.desc(score))
    ranked = rows.select(group, F.col(score).alias("best"), F.lead(score).over(w).alias("_next"), F.row_number().over(w).alias("_i"))
    return ranked.where("_i = 1").select(group, "best", (F.col("best") - F.col("_next")).alias("gap"))


def competing(rows: DataFrame, group: str, key: str, score: str, margin: float = 0.05) -> DataFrame:
    """rows (one a group and key) with whether another key of the group scores at least the row's own score less the margin."""
    w = Window.partitionBy(group).orderBy(F.desc(score), key)
    best = F.first(score).over(w)
    other = F.when(F.row_number().over(w) == 1, F.lead(score).over(w)).otherwise(best)
    return rows.withColumn("competes", F.coalesce(other >= F.col(score) - margin, F.lit(False)))


def nearest_rank(rows: DataFrame, group: str, value: str, share: float) -> DataFrame:
    """Per group: n, and the value whose rank is share * n, rounded up.  The window runs over distinct values and their counts, not over rows."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, F.col(value).alias("value")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(group)
    ranked = counts.select(group, "value", F.sum("_c").over(w).alias("n"), F.sum("_c").over(w.orderBy("value")).alias("_upto"))
    wanted = F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(share)))
    return ranked.where(F.col("_upto") >= wanted).groupBy(group).agg(F.max("n").alias("n"), F.min("value").alias("value"))
