"""Joins of the analyses: by equal keys with a range or an order on lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def in_scope(rows: DataFrame, scopes: DataFrame, keys: list[str], at: str, start: str, end: str, how: str = "inner") -> DataFrame:
    """rows joined to the scopes of the same keys that hold `at`, start and end included.

    The equal keys (a function, a user) are what is shuffled; the range is checked within them.
    """
    a, b = rows.alias("a"), scopes.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col(f"a.{at}").between(F.col(f"b.{start}"), F.col(f"b.{end}"))]
    out = a.join(b, on, how)
    if how in ("left_semi", "left_anti"):
        return out
    return out.select("a.*", *(F.col(f"b.{c}") for c in scopes.columns if c not in keys))


def latest_before(rows: DataFrame, sources: DataFrame, keys: list[str], at: str, source_at: str) -> DataFrame:
    """rows with source_at of the last source at or before them, null without one: one pass in key order, no join."""
    both = rows.withColumn("source_mark", F.lit(0)).withColumn("source_place", F.col(at)).withColumn("source_value", F.lit(None).cast(sources.schema[source_at].dataType))
    marks = sources.select(*keys, F.col(source_at).alias("source_place"), F.col(source_at).alias("source_value"), F.lit(1).alias("source_mark"))
    window = Window.partitionBy(*keys).orderBy("source_place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.unionByName(marks, allowMissingColumns=True).withColumn(source_at, F.max("source_value").over(window))
    return seen.filter("source_mark = 0").select(*rows.columns, source_at)


def absent(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """rows without a match; nulls match nothing."""
    return rows.join(known.select(*keys), keys, "left_anti")


def present(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(known.select(*keys), keys, "left_semi")


def first_of(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("first_n", F.row_number().over(window)).filter("first_n = 1").drop("first_n")
