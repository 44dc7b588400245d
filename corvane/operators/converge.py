"""The convergence pipeline on candidates: seed, filter chain, dedup, rank, ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ordered import numbered


def tagged(candidates: DataFrame, chain: Sequence[tuple[str, Column]]) -> DataFrame:
    """candidates with drop_filter: the first filter of the chain whose condition drops the row, null if none does.

    A condition that is null drops nothing: a filter that can't tell keeps.
    """
    return candidates.withColumn("drop_filter", F.coalesce(*(F.when(drops, F.lit(name)) for name, drops in chain)) if chain else F.lit(None).cast("string"))


def chain_stats(rows: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows in and out of each filter in the chain, from one aggregate over tagged rows."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("chain_rows"), *(F.count(F.when(F.col("drop_filter") == n, 1)).alias(f"chain_dropped_{i}") for i, n in enumerate(names)))
    gone = F.lit(0).cast("long")
    steps = []
    for i, n in enumerate(names):
        before = F.col("chain_rows") - gone
        gone = gone + F.col(f"chain_dropped_{i}")
        steps.append(F.struct(F.lit(i).alias("step"), F.lit(n).alias("filter"), before.alias("rows_in"), (F.col("chain_rows") - gone).alias("rows_out")))
    return counts.select(*by, F.explode(F.array(*steps)).alias("s")).select(*by, "s.*")


def ledger(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every dropped row with `dropped`, how many rows its filter has dropped of its group. Groups are few: types times filters."""
    gone = rows.filter("drop_filter is not null")
    return gone.join(F.broadcast(gone.groupBy(*by, "drop_filter").agg(F.count("*").alias("dropped"))), [*by, "drop_filter"])


def below(rows: DataFrame, target: str, path: str = "path") -> DataFrame:
    """The rows at or below a folder, and those without a path."""
    target, at = target.rstrip("/"), F.col(path)
    return rows.filter((at == "") | (at == target) | at.startswith(target + "/"))


def deduplicated(rows: DataFrame, keys: list[str], line: str, seq: str) -> DataFrame:
    """Of each key the row of the least line, at the place of the first that was seen."""
    window = Window.partitionBy(*keys)
    first = rows.withColumn("converge_first", F.min(seq).over(window)).withColumn("converge_n", F.row_number().over(window.orderBy(line, seq)))
    return first.filter("converge_n = 1").drop("converge_n").withColumn(seq, F.col("converge_first")).drop("converge_first")


def ranked(rows: DataFrame, score: Column, file: str, line: str, seq: str, by: Sequence[str] = ()) -> DataFrame:
    """rows with score and rank: score descending, then file, line and place."""
    order = [F.col("score").desc(), F.col(file), F.col(line), F.col(seq)]
    return numbered(rows.withColumn("score", score), list(by), order, "rank")
