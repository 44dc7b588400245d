"""What several operators use: the shared folder, joins on skewed keys, held-out rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.closure import cut, shared_folder

__all__ = ["cut", "held_out", "lookup", "shared_folder"]


def lookup(left: DataFrame, right: DataFrame, key: str, rows: str, total: int, spread: str, most: int = 1000) -> DataFrame:
    """left with right's columns, a left join on key, whatever the key's skew in left.

    right has each key once, and in the column `rows` how many rows of left have it, of
    `total` in all. Fewer than `most` keys can hold more than total / most rows; those
    are broadcast. Their rows of left then go by a hash of the column `spread`.
    """
    hot = F.col(rows) > F.lit(total / most)
    kind = dict(right.dtypes)[key]
    others = [c for c in right.columns if c != key]
    named = lambda df, p: df.select(F.col(key).alias(f"_{p}key"), *(F.col(c).alias(f"_{p}{c}") for c in others), F.lit(True).alias(f"_{p}in"))
    a, b = named(right.filter(hot), "h"), named(right.filter(~hot), "c")
    out = left.join(F.broadcast(a), left[key] == a["_hkey"], "left")
    # a hot row looks for nothing below, and goes where its own hash says; as a struct the key stays one key
    salt = F.when(F.col("_hin") | F.col(key).isNull(), F.pmod(F.xxhash64(spread), F.lit(1 << 20))).otherwise(F.lit(-1).cast("long"))
    out = out.withColumn("_cold", F.struct(F.when(F.col("_hin"), F.lit(None).cast(kind)).otherwise(F.col(key)).alias("key"), salt.alias("salt")))
    b = b.withColumn("_ckey", F.struct(F.col("_ckey").alias("key"), F.lit(-1).cast("long").alias("salt")))
    out = out.join(b, out["_cold"] == b["_ckey"], "left")
    keep = [left[c] for c in left.columns]
    return out.select(*keep, *(F.when(F.col("_hin"), F.col(f"_h{c}")).otherwise(F.col(f"_c{c}")).alias(c) for c in others))


def held_out(column: str, modulus: int, remainder: int):
    """Whether the CRC-32 of the id as text leaves this remainder; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))
