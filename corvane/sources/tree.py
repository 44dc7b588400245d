"""C source trees as binary files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.knowledge import EXCLUDED_DIRS
from ..functions.scalars import line_count


def excluded(path, names: Sequence[str]):
    """Whether a folder of the path, without its last part, has an excluded name, in whatever case."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(folders, lambda s: F.lower(s).isin(*[n.lower() for n in names]))


def read_tree(spark: SparkSession, root: str, exclude: Sequence[str] = EXCLUDED_DIRS) -> DataFrame:
    """path, checksum, loc and source of each .c and .h file below root, excluded folders aside.

    Only folders below root, and root's own name, are held against the list.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{c,h,C,H}").load(root)
    base = root.rstrip("/").split("://")[-1]
    own = F.regexp_replace("path", r"^[a-z]+:(//[^/]*)?(?=/)", "")
    below = F.when(own.startswith(base + "/"), F.concat(F.lit(base.rsplit("/", 1)[-1]), F.substring(own, F.lit(len(base) + 1), F.length(own)))).otherwise(own)
    rows = files.select(own.alias("path"), below.alias("below"), "content")
    if exclude:
        rows = rows.filter(~excluded(F.col("below"), exclude))
    text = F.decode("content", "ISO-8859-1")
    return rows.select("path", F.sha2("content", 256).alias("checksum"), line_count(text).alias("loc"), text.alias("source"))


def changed(files: DataFrame, stored: DataFrame) -> DataFrame:
    """The files whose checksum isn't the stored one, or that aren't stored."""
    known = stored.select("path", "checksum")
    return files.join(known, ["path", "checksum"], "left_anti")
