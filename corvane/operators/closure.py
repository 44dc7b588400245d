"""Reachability and strong components over edges: rounds, written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: So many rounds' tables are read side by side before they become one.
TABLES_BETWEEN = 8
#: A graph of at most so many edges is followed in memory: sent to every task for reach(), in one task for strong_components(). The rows are the same either way.
SMALL_EDGES = 200_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and Spark runs in one process, as in tests, a new local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is unset: executors need a folder that all of them share")
        found = f"file://{tempfile.mkdtemp(prefix='corvane-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to a table in the shared folder and read again: computed once, and kept when executors are lost.

    The folder is the session's: whoever names it in spark.checkpoint.dir deletes it after.
    """
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(node: str):
    """A node of any type as a string; readable() reads it again."""
    return F.to_json(F.struct(F.col(node).alias("node")))


def readable(column: str, kind: T.DataType):
    return F.from_json(column, T.StructType([T.StructField("node", kind)]))["node"]


def followed(links: DataFrame, entries: DataFrame) -> DataFrame:
    """reach() over few links: each root's entries are followed in one task, which has all links."""
    kinds = entries.schema["root"].dataType, entries.schema["node"].dataType
    to: dict[str, list[str]] = {}
    for r in links.select(written("src").alias("a"), written("dst").alias("b")).toLocalIterator():
        to.setdefault(r["a"], []).append(r["b"])
    sent = links.sparkSession.sparkContext.broadcast(to)

    def follow(start: pd.DataFrame) -> pd.DataFrame:
        seen, stack = set(start["node"]), list(start["node"])
        while stack:
            for n in sent.value.get(stack.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    stack.append(n)
        return pd.DataFrame({"root": start["root"].iloc[0], "node": sorted(seen)})

    # of a root's entries only those that lead on must come together
    sources = links.select(F.col("src").alias("node")).distinct()
    rows = entries.join(F.broadcast(sources), "node", "left_semi").select(written("root").alias("root"), written("node").alias("node"))
    found = rows.groupBy("root").applyInPandas(follow, "root string, node string")
    found = found.select(readable("root", kinds[0]).alias("root"), readable("node", kinds[1]).alias("node"))
    return cut(found.unionByName(entries.join(F.broadcast(sources), "node", "left_anti").select("root", "node")).distinct())


def reach(edges: DataFrame, entries: DataFrame, most_rounds: int = 1000, small: int = SMALL_EDGES) -> DataFrame:
    """(root, node) for each node that edges (src, dst) lead to from an entry (root, node), the entry too.

    A round joins only what the last one found; cycles end because what is known is left out.
    Up to `small` edges are followed in memory instead.
    """
    links = cut(edges.select("src", "dst").distinct())
    if links.count() <= small:
        return followed(links, cut(entries.select("root", "node").distinct()))
    frontier = cut(entries.select("root", "node").distinct())
    seen, tables = frontier, 1
    for _ in range(most_rounds):
        step = frontier.join(links, frontier["node"] == links["src"]).select("root", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, ["root", "node"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen, tables = seen.unionByName(frontier), tables + 1
        if tables == TABLES_BETWEEN:
            seen, tables = cut(seen), 1
    raise RuntimeError(f"reachability has not settled in {most_rounds} rounds")


def least_reaching(edges: DataFrame, labels: DataFrame, most_rounds: int) -> DataFrame:
    """(node, label): the least label of the nodes that lead to each node, its own included. A round passes on only labels that have changed."""
    now = moved = labels
    for _ in range(most_rounds):
        step = moved.join(edges, moved["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("label"))
        better = step.join(now.withColumnRenamed("label", "own"), "node").filter("label < own").select("node", "label")
        moved = cut(better)
        if moved.isEmpty():
            return now
        now = cut(now.join(moved.withColumnRenamed("label", "new"), "node", "left").select("node", F.coalesce("new", "label").alias("label")))
    raise RuntimeError(f"labels have not settled in {most_rounds} rounds")


def components_of(links: pd.DataFrame) -> pd.DataFrame:
    """(node, component) of each node on a cycle, by Tarjan's algorithm on a stack of its own; component is a number."""
    to: dict[str, list[str]] = {}
    for a, b in zip(links["src"], links["dst"], strict=True):
        to.setdefault(a, []).append(b)
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack, inside, out = [], set(), []
    for root in to:
        if root in index:
            continue
        work = [(root, iter(to[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        inside.add(root)
        while work:
            node, rest = work[-1]
            for n in rest:
                if n not in index:
                    index[n] = low[n] = len(index)
                    stack.append(n)
                    inside.add(n)
                    work.append((n, iter(to.get(n, ()))))
                    break
                if n in inside:
                    low[node] = min(low[node], index[n])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while True:
                        members.append(stack.pop())
                        inside.discard(members[-1])
                        if members[-1] == node:
                            break
                    if len(members) > 1:
                        out += [(m, index[node]) for m in members]
    return pd.DataFrame(out, columns=["node", "component"])


def strong_components(edges: DataFrame, most_rounds: int = 1000, small: int = SMALL_EDGES) -> DataFrame:
    """(node, component) for each node on a cycle of two or more; a component is named by its least node.

    By colouring, without a closure of all pairs: each node takes the least label that leads
    to it; those of a label's nodes that lead back to its owner are the owner's component.
    Components found and edges between labels go, and the rest is coloured anew. Labels are
    hashes, so that a long path falls apart in about log n such passes. A table is at most
    as large as the edges. A pass has as many rounds as the longest shortest path has steps.
    Once at most `small` edges are left, one task finds their components.
    """
    spark = edges.sparkSession
    left = cut(edges.filter("src <> dst").select("src", "dst").distinct())
    kind = left.schema["src"].dataType
    found = []
    for _ in range(most_rounds):
        # what nothing leads to, or what leads nowhere, is on no cycle
        left = left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        left = cut(left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        size = left.count()
        if not size:
            break
        if size <= small:
            found.append(in_one_task(left))
            break
        label = F.struct(F.xxhash64("node").alias("hash"), F.col("node").alias("node"))
        nodes = left.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", label.alias("label"))
        colours = cut(least_reaching(left, cut(nodes), most_rounds))
        inside = left.join(colours.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(colours.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst")
        inside = cut(inside.filter("a = b").select("src", "dst", F.col("a.node").alias("owner")))
        # back from each label's owner, within the label
        back = inside.select(F.struct("owner", F.col("dst").alias("node")).alias("src"), F.struct("owner", F.col("src").alias("node")).alias("dst"))
        owners = colours.filter(F.col("label.node") == F.col("node")).select(F.col("node").alias("root"), F.struct(F.col("node").alias("owner"), F.col("node")).alias("node"))
        own = cut(reach(back, owners, most_rounds, small).select(F.col("root").alias("owner"), F.col("node.node").alias("node")))
        found.append(own)
        gone = own.select("node")
        left = cut(inside.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
    else:
        raise RuntimeError(f"components have not settled in {most_rounds} passes")
    if not found:
        return spark.createDataFrame([], edges.select(F.col("src").alias("node"), F.col("src").alias("component")).schema)
    members = found[0]
    for x in found[1:]:
        members = members.unionByName(x)
    names = members.groupBy("owner").agg(F.min("node").alias("component"), F.count("*").alias("size")).filter("size > 1")
    return members.join(names, "owner").select(F.col("node").cast(kind).alias("node"), F.col("component").cast(kind).alias("component"))


def in_one_task(links: DataFrame) -> DataFrame:
    """(owner, node) for each node on a cycle of few links; an owner is one of its component's nodes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if held:
            yield components_of(pd.concat(held, ignore_index=True).sort_values(["src", "dst"]))

    rows = links.select(written("src").alias("src"), written("dst").alias("dst")).coalesce(1)
    got = rows.mapInPandas(run, "node string, component long").select(readable("node", links.schema["src"].dataType).alias("node"), "component")
    names = got.groupBy("component").agg(F.min("node").alias("owner"))
    return cut(got.join(names, "component").select("owner", "node"))


def mutual(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose nodes lead to each other over edges: they share a strong component."""
    of = strong_components(edges)
    a, b = (of.select(F.col("node").alias(x), F.col("component").alias(f"{x}_of")) for x in ("a", "b"))
    return pairs.join(a, "a").join(b, "b").filter("a_of = b_of and a <> b").select(*pairs.columns)
