"""The property graph of a scan's facts, as two tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def node_id(kind: Column, owner: Column, name: Column) -> Column:
    """A node's id follows from what it is, so every run gives the same."""
    return F.xxhash64(kind, owner, name)


#: Kinds of edges with an end that is a function's, and so may be outside the program.
CALLED = ("CALL", "PARAM_BINDING", "RETURN")


def edges(facts: DataFrame, kinds: Sequence[str] | None = None) -> DataFrame:
    """Edges, all or of the kinds, with their ends named: a call's end is the function if some file has it, else external."""
    e = facts.filter(F.col("record") == "edge") if kinds is None else facts.filter((F.col("record") == "edge") & F.col("kind").isin(*kinds))
    e = e.select("path", "function", "kind", "line", "src", "dst", "note", F.col("props")["src_kind"].alias("src_kind"), F.col("props")["dst_kind"].alias("dst_kind"))
    known = facts.filter("record = 'function'").select(F.col("function").alias("name")).distinct().withColumn("known", F.lit(True))
    callee = F.when(F.col("src_kind") == "return_slot", F.col("src")).when(F.col("dst_kind").isin("function", "parameter"), F.col("dst"))
    e = e.withColumn("callee", callee)
    e = e.join(known, F.col("callee") == F.col("name"), "left").drop("name") if kinds is None or set(kinds) & set(CALLED) else e.withColumn("known", F.lit(None).cast("boolean"))
    outside = F.col("callee").isNotNull() & F.col("known").isNull()
    # of calls to unknown functions only the call itself is kept
    e = e.filter(~outside | (F.col("kind") == "CALL"))
    dst_kind = F.when(outside, "external_function").otherwise(F.col("dst_kind"))
    own = F.concat_ws("::", "path", "function")
    shared = ("mutex", "global_var", "external_function", "function", "return_slot", "parameter")
    src_owner = F.when(F.col("src_kind").isin(*shared), F.lit("")).otherwise(own)
    dst_owner = F.when(dst_kind.isin(*shared), F.lit("")).otherwise(own)
    # a parameter is named by its function and place
    dst = F.when(dst_kind == "parameter", F.concat_ws("#", "dst", "note")).otherwise(F.col("dst"))
    e = e.select("path", "function", F.col("kind").alias("edge_type"), "line", "src_kind", src_owner.alias("src_owner"), "src", dst_kind.alias("dst_kind"), dst_owner.alias("dst_owner"), dst.alias("dst"), "note")
    return e.withColumn("src_id", node_id(F.col("src_kind"), F.col("src_owner"), F.col("src"))).withColumn("dst_id", node_id(F.col("dst_kind"), F.col("dst_owner"), F.col("dst")))


def nodes(graph_edges: DataFrame) -> DataFrame:
    """Every end of an edge once."""
    ends = [graph_edges.select(F.col(f"{s}_id").alias("id"), F.col(f"{s}_kind").alias("entity_type"), F.col(f"{s}_owner").alias("owner"), F.col(s).alias("name")) for s in ("src", "dst")]
    return ends[0].unionByName(ends[1]).dropDuplicates(["id"])
