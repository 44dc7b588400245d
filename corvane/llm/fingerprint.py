"""Document fingerprints: bottom-k sketches of shingle hashes, in native expressions.

A sketch is the k smallest distinct hashes of a text's word shingles, ascending. Two
sketches merge to that of both texts' union; from them follow estimates of resemblance,
containment and the number of distinct shingles. Texts of fewer words than a shingle have
one shingle of all their words; a text without words has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import cut

K, SHINGLE = 128, 5
#: Hashes are the upper 32 bits of xxHash64: a document has far fewer shingles than 2**32.
SPACE = float(1 << 32)


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The text's sketch, an array of integers. A null text counts as empty."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        several = F.transform(F.sequence(F.lit(1), F.size(h) - (shingle - 1)), lambda i: upper(F.xxhash64(*(h[i + (j - 1)] for j in range(shingle)))))
        return F.when(F.size(h) >= shingle, several).when(F.size(h) > 0, F.array(upper(F.xxhash64(h)))).otherwise(F.array().cast("array<int>"))

    def upper(x: Column) -> Column:
        return F.shiftright(x, 32).cast("int")

    return F.slice(F.sort_array(F.array_distinct(let(hashes, shingles))), 1, k)


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of both texts' shingles."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness; 1 for two sketches without shingles."""
    both = lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))
    return let(merged(a, b, k), both)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k."""
    kth = F.element_at(a, -1).cast("double") + SPACE / 2 + 1
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) * SPACE / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 if a has none."""
    likeness = resemblance(a, b, k)
    shared = likeness / (1 + likeness) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """The sketch as a string: each hash as eight hexadecimal digits."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.lower(F.hex(F.shiftrightunsigned(F.shiftleft(x.cast("long"), 32), 32))), 8, "0")), "")


def next_ids(rows: DataFrame) -> DataFrame:
    """rows (id, tie and others) with next_id, next_tie: of the row after it by descending id, after the last the first.

    Rows are dealt to partitions by ranges of id. Each partition orders its own, and one row
    of each, its first, is looked up by the partition before it. Rows must be distinct.
    """
    order = [F.col("id").desc_nulls_last(), F.col("tie").desc()]
    dealt = cut(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("part").orderBy(*order)
    here = F.struct(F.col("id").alias("next_id"), F.col("tie").alias("next_tie"))
    firsts = dealt.groupBy("part").agg(F.max_by(here, F.struct(F.col("id").isNotNull(), "id", "tie")).alias("first"))
    # one row for each partition
    all_parts = Window.orderBy("part")
    top = F.first("first").over(all_parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = firsts.select("part", F.coalesce(F.lead("first").over(all_parts), top).alias("after"))
    out = dealt.withColumn("own", F.lead(here).over(within)).join(F.broadcast(after), "part")
    return out.select(*rows.columns, F.coalesce("own", "after").alias("x")).select(*rows.columns, "x.next_id", "x.next_tie")


def with_edited(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_chars, the text's sketch, the edited text, its sketch, and the next document's sketch and id.

    Whole texts are shuffled once, by document; what a document gives to the one before it
    is its sketch and as many characters as that one replaces. A null text counts as empty.
    A null doc_id comes after all others; of equal ids the texts' hashes decide. Rows that
    are equal in id and text are one document in this order, and all get its results. With
    one document it is its own next. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    slim = keyed.groupBy("id", "tie").agg(F.first(F.char_length("text")).cast("long").alias("n"), F.count("*").alias("copies"))
    order = cut(next_ids(slim))
    key = F.xxhash64("id", "tie")
    takes = order.select(F.xxhash64("next_id", "next_tie").alias("k"), F.col("next_tie").alias("tie"), key.alias("to_k"), F.col("tie").alias("to_tie"), F.floor(F.col("n") / 3).cast("int").alias("take"))
    # both joins below read all of held's columns, so Spark computes and shuffles it once
    held = keyed.select(key.alias("k"), "tie", "id", "text", sketch(F.col("text"), k, shingle).alias("sketch")).repartition("k", "tie")
    given = held.join(takes.hint("shuffle_hash"), ["k", "tie"], "left").select(F.col("to_k").alias("k"), F.col("to_tie").alias("tie"), F.substring("text", F.lit(1), F.col("take")).alias("piece"), F.col("sketch").alias("next_sketch"), F.col("id").alias("next_id"))
    if order.filter("copies > 1").limit(1).count():
        given = given.dropDuplicates(["k", "tie"])
    out = held.join(given.hint("shuffle_hash"), ["k", "tie"], "left")
    n = F.char_length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 3).cast("int")), "piece")
    out = out.select("id", n.cast("long").alias("n_chars"), "sketch", edited.alias("edited"), "next_sketch", "next_id")
    return out.select(F.col("id").alias("doc_id"), "n_chars", "sketch", "edited", sketch(F.col("edited"), k, shingle).alias("edited_sketch"), "next_sketch", "next_id")


def op4(docs: DataFrame) -> DataFrame:
    """The columns of with_edited() as strings and likenesses; it says what becomes of nulls, ties, repeats and empty tables."""
    got = with_edited(docs)
    return got.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"), resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"), "next_id")
