"""Basin aggregation: cells to regions through a mask, regions to weighted totals, days to months."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def basin_means(df: DataFrame, mask: DataFrame, keys: list[str], cell: list[str], variables: list[str], region: str = "region_id") -> DataFrame:
    """Mean of each variable over a region's cells; cells outside all regions drop out."""
    inside = mask.where(F.col(region).isNotNull())
    return df.join(inside, cell).groupBy(*keys, region).agg(*[F.avg(v).alias(v) for v in variables])


def weighted_total(df: DataFrame, weights: DataFrame, keys: list[str], variables: list[str], region: str = "region_id", weight: str = "weight") -> DataFrame:
    """Sum over the regions of value times weight; a missing product counts as 0."""
    joined = df.join(weights.select(region, weight), region)
    return joined.groupBy(*keys).agg(*[F.sum(F.coalesce(F.col(v) * F.col(weight), F.lit(0.0))).alias(v) for v in variables])


def monthly_basin(df: DataFrame, keys: list[str], sums: list[str], means: list[str], time: str = "time") -> DataFrame:
    """Monthly sums of some variables and means of the others."""
    return df.groupBy(*keys, F.date_trunc("month", F.col(time)).cast("date").alias("month")).agg(*[F.sum(v).alias(v) for v in sums], *[F.avg(v).alias(v) for v in means])


def output_name(source: str, experiment: str, member: str, suffix: str) -> str:
    """File name of a run's output."""
    return f"{source}_{experiment}_{member}_{suffix}.csv"
