"""Stored tables against new rows: change detection and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changes(old: DataFrame, new: DataFrame, key: str, checksum: str) -> DataFrame:
    """(key, change) for every key: unchanged, changed, new or gone."""
    a, b = old.select(key, F.col(checksum).alias("_old")), new.select(key, F.col(checksum).alias("_new"))
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), key, "full")
    return both.select(key, F.when(F.col("_a").isNull(), "new").when(F.col("_b").isNull(), "gone").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed").alias("change"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], kept: list[str], default: dict[str, str] | None = None) -> DataFrame:
    """old with new rows merged in by key; a row that both have takes the new values but for the kept columns."""
    names = old.columns
    a = old.select(*(F.col(c).alias(f"o_{c}") for c in names), F.lit(True).alias("_a"))
    b = new.select(*(F.col(c).alias(f"n_{c}") for c in new.columns), F.lit(True).alias("_b"))
    on = [F.col(f"o_{k}").eqNullSafe(F.col(f"n_{k}")) for k in keys]
    both = a.join(b, on, "full")

    def value(c: str):
        of_new = F.col(f"n_{c}") if c in new.columns else F.lit(None).cast(old.schema[c].dataType)
        if default and c in default:
            of_new = F.coalesce(of_new, F.lit(default[c]))
        if c in kept:
            return F.when(F.col("_a").isNotNull(), F.col(f"o_{c}")).otherwise(of_new)
        return F.when(F.col("_b").isNotNull(), of_new).otherwise(F.col(f"o_{c}"))

    return both.select(*(value(c).alias(c) for c in names))
