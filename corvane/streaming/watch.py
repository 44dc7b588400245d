"""New source files as a stream: each batch is extracted, and its facts appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import line_count
from ..plans.kernel import facts

BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def source_stream(spark: SparkSession, root: str) -> DataFrame:
    """path, checksum, loc, source of files that appear below root."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", "*.{c,h}").option("recursiveFileLookup", "true").load(root)
    text = F.decode("content", "ISO-8859-1")
    return files.select("path", F.sha2("content", 256).alias("checksum"), line_count(text).alias("loc"), text.alias("source"), "modificationTime")


def watch(spark: SparkSession, root: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends the facts of new files to the folder target, each batch once: a batch writes its own partition."""

    def each(batch: DataFrame, number: int) -> None:
        facts(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return source_stream(spark, root).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
