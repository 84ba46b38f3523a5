"""Contiguous shards of near equal byte size (DataFrame functions only).

The rows are put in a total order, range-partitioned by it and written to the
shared folder with the number of their partition.  Each partition's bytes and
rows are totalled (one row a partition), the totals are summed up into
offsets, and a row's global byte position is its partition's offset plus its
running sum inside the partition.  A row belongs to shard
``floor(middle * shards / total)``, where ``middle`` is the position of its
middle byte: cuts at equal targets, so a shard's size differs from
``total / shards`` by at most half a row at either end.

The order is by digest of the text, then document id, so shards mix sources
and equal texts stand together: a group of equal texts is split only where a
cut falls into it.  A hot key or a large group of copies spreads over as many
range partitions as its rows need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table, text_of

LAW = "bytes"


def shard_by_bytes(
    docs: DataFrame,
    shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Every row of ``docs`` with its shard.

    Size of a row: UTF-8 bytes of its text plus 1; a null text has size 1 and
    the CRC of the empty text.  Null ids, repeated rows and ties are kept, each
    with a slot of its own; an empty table gives no rows.  ``carry`` names
    further columns to take along (returned as struct ``carried``, so names
    cannot clash), as ``write_shards`` needs.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text_of(text)).alias("text_crc32"),
        F.xxhash64(text_of(text)).alias("digest"),
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("carried")] if carry else []),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = ["digest", "text_crc32", "doc_id", "tie"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    rows = shared_table(ranged, "shards")

    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = rows.withColumn("upto", F.sum("size").over(inside)).withColumn("nth", F.row_number().over(inside))
    placed = running.join(F.broadcast(offsets), "part")  # as many rows as there are partitions
    start = F.col("bytes_before") + F.col("upto") - F.col("size")
    placed = placed.select(
        "doc_id", "size", "text_crc32", *(["carried"] if carry else []),
        start.alias("start_byte"),
        # by its middle, so a shard misses its target by half a row at either end
        F.expr(f"(2 * (bytes_before + upto) - size) * {int(shards)} div (2 * total)").cast("int").alias("shard"),
        (F.col("rows_before") + F.col("nth") - 1).alias("row_no"),
    )
    firsts = placed.groupBy("shard").agg(F.min("row_no").alias("first_row"))  # one row a shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32",
        F.lit(LAW).alias("law"),
        "shard",
        (F.col("row_no") - F.col("first_row")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "start_byte", *(["carried"] if carry else []),
    )


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents as one folder a shard (``shard=0`` ...), in many
    files each, so that no task holds a whole shard."""
    placed = shard_by_bytes(docs, shards, id_col, text_col, carry=docs.columns)
    placed.select("shard", "slot", "carried").write.partitionBy("shard").parquet(path)
