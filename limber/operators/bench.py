"""Summaries of detector runs.

Edge cases: a null ``detected`` counts as not detected; null times and
confidences count for nothing; a repeated run counts again; a null group is a
group; no runs give no groups, or one row of zeros and nulls without a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bench_summary(runs: DataFrame, *by: str) -> DataFrame:
    """Per group: n_images, n_detected, avg_confidence (over the detected, 0 if none), avg_time (the detected runs' time over all images) and avg_time_detected."""
    hit = F.coalesce(F.col("detected"), F.lit(False))
    time = F.sum(F.when(hit, F.col("elapsed_s")))
    return runs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_images"),
        F.count_if(hit).alias("n_detected"),
        F.coalesce(F.avg(F.when(hit, F.col("confidence"))), F.lit(0.0)).alias("avg_confidence"),
        F.try_divide(F.coalesce(time, F.lit(0.0)), F.count(F.lit(1))).alias("avg_time"),
        F.coalesce(F.avg(F.when(hit, F.col("elapsed_s"))), F.lit(0.0)).alias("avg_time_detected"),
    )


def slowdown(runs: DataFrame, key: str, variant: Column, time_col: str = "elapsed_s", conf_col: str = "confidence") -> DataFrame:
    """Per key the mean time of the rows where ``variant`` holds over that of the rest, and both mean confidences; null without either side."""
    of = lambda c, v: F.avg(F.when(v, F.col(c)))
    return runs.groupBy(key).agg(
        F.try_divide(of(time_col, variant), of(time_col, ~variant)).alias("slowdown"),
        of(conf_col, ~variant).alias("conf_single"),
        of(conf_col, variant).alias("conf_variant"),
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n_rows."""
    counts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counts)
