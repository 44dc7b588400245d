"""Numbers and neighbours in an order, with no task that holds all of a key's rows.

Rows are dealt to ranges of (keys, order) and written. Within a range a window does; what
crosses ranges is a row for each key and range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .closure import cut


def dealt(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """rows with the number of their range. Rows that are equal in keys and order share one."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(rows.repartitionByRange(parts, *keys, *order).withColumn("range_no", F.spark_partition_id()))


def by_range(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    other = ranges.select(*(F.col(k).alias(f"range_{k}") for k in keys), F.col("range_no").alias("range_other"), *(c for c in ranges.columns if c not in (*keys, "range_no")))
    on = F.col("range_no") == F.col("range_other")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"range_{k}"))
    return rows.join(other, on, "left").drop("range_other", *(f"range_{k}" for k in keys))


def numbered(rows: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """rows with their number, from 1, in the order within their keys. Equal rows are numbered in some order."""
    d = dealt(rows, keys, order)
    before = Window.partitionBy(*keys).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy(*keys, "range_no").agg(F.count("*").alias("range_rows"))
    starts = counts.withColumn("range_start", F.coalesce(F.sum("range_rows").over(before), F.lit(0))).drop("range_rows")
    own = d.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "range_no").orderBy(*order)))
    return by_range(own, starts, keys).withColumn(name, F.col(name) + F.col("range_start")).select(*rows.columns, name)


def following(rows: DataFrame, keys: list[str], order: list[str], wanted: dict[str, str]) -> DataFrame:
    """rows with columns of the next row of their keys: wanted maps new names to columns. The last row of a key has nulls."""
    d = dealt(rows, keys, [F.col(c) for c in order])
    got = F.struct(*(F.col(c).alias(n) for n, c in wanted.items()))
    firsts = d.groupBy(*keys, "range_no").agg(F.min_by(got, F.struct(*order)).alias("range_first"))
    later = firsts.withColumn("range_next", F.lead("range_first").over(Window.partitionBy(*keys).orderBy("range_no"))).drop("range_first")
    own = d.withColumn("range_own", F.lead(got).over(Window.partitionBy(*keys, "range_no").orderBy(*order)))
    out = by_range(own, later, keys).withColumn("range_got", F.coalesce("range_own", "range_next"))
    return out.select(*rows.columns, *(F.col(f"range_got.{n}").alias(n) for n in wanted))
