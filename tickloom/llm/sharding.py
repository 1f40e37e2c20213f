"""Contiguous shards of near-equal bytes from global prefix sums of row sizes.

Rows are range-partitioned and sorted by (doc_id, text hash); every partition contributes one
total, a window over those totals (one row per partition) gives each partition's start, and a
running sum inside the partition gives each row's start. A row goes to the shard in
which its first byte falls when the whole is cut at equal targets.

Defined cases: null text counts as no bytes; null doc_id orders last; repeated rows take
neighbouring places; an empty table gives an empty result; more shards than rows leave some empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import doc_order, doc_text, partitions, stored, table

SHARDS, OVERHEAD = 24, 8


def shard_plan(docs: DataFrame, n_shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): one row per document, texts are not moved."""
    spark = docs.sparkSession
    small = docs.select("doc_id", doc_order().alias("did"), (F.octet_length(doc_text()) + overhead).cast("long").alias("size"),
                        F.crc32(doc_text()).alias("text_crc32"), F.xxhash64(doc_text()).alias("th"))
    laid = stored(small.repartitionByRange(partitions(spark), "did", "th").sortWithinPartitions("did", "th")
                  .withColumn("seq", F.monotonically_increasing_id()), "layout")
    # the upper bits of ``seq`` name the partition, so the layout is fixed by what was written
    part = F.shiftright("seq", 33)
    rows = laid.withColumn("part", part)
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("before"))
    totals = laid.groupBy(part.alias("part")).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("base"),
                           F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("row_base"),
                           F.sum("bytes").over(Window.partitionBy()).alias("whole"))
    # one row per partition of the layout: bounded by the partition count, whatever the data
    placed = rows.join(F.broadcast(starts), "part")
    at = F.col("base") + F.col("before")
    shard = F.expr(f"cast(least({n_shards - 1}, (base + before) * {n_shards}L div greatest(whole, 1L)) as int)")
    rank = F.col("row_base") + (F.col("seq") - F.shiftleft("part", 33))
    placed = placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), rank.alias("rank"), at.alias("first_byte"))
    first = placed.groupBy("shard").agg(F.min("rank").alias("first_rank"))  # at most n_shards rows
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("rank") - F.col("first_rank")).alias("slot"), "first_byte")


def op8(spark, sf_dir):
    plan = shard_plan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return plan.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op8_sharding": (op8, None)}
