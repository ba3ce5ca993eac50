"""Counts over records and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lifecycle_report(records: DataFrame, dimensions: list[str], created: Column, since: str, until: str) -> DataFrame:
    """dimension, value, n, n_created: each dimension by value and all rows, in one pass of grouping sets.

    n_created counts rows made in [since, until).
    """
    made = F.coalesce((created >= F.lit(since).cast("timestamp")) & (created < F.lit(until).cast("timestamp")), F.lit(False))
    rows = records.select(*[F.coalesce(F.col(d).cast("string"), F.lit("(null)")).alias(d) for d in dimensions], made.alias("__made"))
    grouped = rows.groupingSets([[F.col(d)] for d in dimensions] + [[]], *[F.col(d) for d in dimensions]).agg(F.count("*").alias("n"), F.count_if("__made").alias("n_created"))
    name = F.coalesce(*[F.when(F.col(d).isNotNull(), F.lit(d)) for d in dimensions], F.lit("all"))
    return grouped.select(name.alias("dimension"), F.coalesce(*[F.col(d) for d in dimensions], F.lit("all")).alias("value"), "n", "n_created")


def created_in(records: DataFrame, created: Column, since: str, until: str) -> DataFrame:
    return records.where((created >= F.lit(since).cast("timestamp")) & (created < F.lit(until).cast("timestamp")))


def keep_newest(rows: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The rows to drop so that the ``n`` newest of each key stay."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where(F.col("__n") > n).drop("__n")


def multiset_fingerprint(rows: DataFrame, key: list[str], value: Column) -> DataFrame:
    """n, low, high: a fingerprint of each key's rows that their order doesn't change (sums of digest halves)."""
    digest = F.sha2(value, 256)
    half = lambda at: F.sum(F.conv(F.substring(digest, at, 14), 16, 10).cast("decimal(38,0)"))
    return rows.groupBy(*key).agg(F.count("*").alias("n"), half(1).alias("low"), half(15).alias("high"))


def first_wins(parts: list[DataFrame], key: list[str]) -> DataFrame:
    """Union by key; the row of the earliest part stays."""
    from functools import reduce

    rows = reduce(DataFrame.unionByName, [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)])
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy("part"))).where("__n = 1").drop("__n")


def prefix_pack(rows: DataFrame, key: list[str], order: list[Column], size: Column, budget: int) -> DataFrame:
    """The rows of each key, in order, that fit into a budget of bytes; the first that doesn't ends it."""
    run = F.sum(size).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("used", run).where(F.col("used") <= budget)
