"""Exact de-duplication by an extendible-hash index (DataFrame functions only).

1. Every row's normalised text is hashed (64 bits, and SHA-256 for the result);
   the slim rows go to the shared folder.
2. The directory starts at the depth that would hold the keys in buckets of
   ``capacity`` and doubles: a bucket is a prefix of the hash, one that is
   overfull splits by its next bit, until every bucket fits.  A bucket of less
   than the directory's depth fills several slots of it.  The depth is limited
   to ``MAX_DEPTH`` (at most 2**16 slots, so the directory may be broadcast);
   what is still overfull there stays a longer chain.
3. Claims: rows meet in their bucket by hash and bytes.  Grouping by the text
   itself compares bytes, so texts of one hash that differ become links of a
   chain.  Copies collapse before the shuffle, so a large group of copies is a
   row a task there.
4. Owner tasks take key ranges: the claims are range-partitioned by bucket and
   hash and written as the index files.
5. The slim rows look up their group in the index.  Large groups are few (at
   most ``1 / HOT_SHARE`` of them) and are broadcast; all others are joined.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_table, text_of

CAPACITY = 8192
MAX_DEPTH = 16
HOT_SHARE = 1e-4
BLANK = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text without spaces, tabs, line feeds, vertical tabs, form feeds
    and carriage returns."""
    return F.regexp_replace(text, BLANK, "")


def _prefix(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def build_directory(keys: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, int]:
    """The directory ``(slot, depth, bucket)`` of the distinct hashes ``key``
    and its depth.  ``bucket`` is the bucket's first slot."""
    n = keys.count()
    depth = min(max_depth, max(0, math.ceil(math.log2(n / capacity)))) if n else 0
    open_keys, done = keys, None
    while True:
        sizes = shared_table(open_keys.groupBy(_prefix(F.col("key"), depth).alias("prefix")).agg(F.count(F.lit(1)).alias("n")), "directory")
        fits = F.lit(True) if depth >= max_depth else F.col("n") <= capacity
        kept = sizes.where(fits).select(F.lit(depth).alias("depth"), "prefix")
        done = kept if done is None else done.unionByName(kept)
        full = sizes.where(~fits).select("prefix")
        if full.isEmpty():
            break
        # at most 2**max_depth prefixes
        open_keys = open_keys.join(F.broadcast(full), _prefix(F.col("key"), depth) == F.col("prefix"), "left_semi")
        depth += 1
    width = F.pow(F.lit(2), F.lit(depth) - F.col("depth")).cast("long")
    slots = done.select(
        "depth",
        (F.col("prefix") * width).alias("bucket"),
        F.explode(F.sequence(F.col("prefix") * width, (F.col("prefix") + 1) * width - 1)).alias("slot"),
    )
    return shared_table(slots, "directory"), depth


def exact_groups(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per row of ``docs`` with the group of equal texts it is in.

    Texts are equal when identical after ``normalised``; null counts as empty.
    Of a group the row with the most code points in the original text stays,
    then the smallest ``doc_id`` (a null id comes last); of identical rows one.
    Returns ``doc_id, keep_id, group_size, kept, text_sha256, bucket, link``
    (the bucket and the place in its hash's chain).  Empty tables give no rows.
    """
    text = text_of()
    source = docs.select(
        F.col("doc_id").alias("doc_id"), F.char_length(text).cast("long").alias("n"), normalised(text).alias("norm")
    ).withColumn("key", F.xxhash64("norm"))
    # equal rows travel as one with their number
    slim = shared_table(
        source.select("doc_id", "n", "key", F.unhex(F.sha2("norm", 256)).alias("sha")).groupBy("doc_id", "n", "key", "sha").agg(F.count(F.lit(1)).alias("times")),
        "exact-rows",
    )
    directory, depth = build_directory(slim.select("key").distinct(), capacity)

    best = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id")
    claims = (
        source.withColumn("slot", _prefix(F.col("key"), depth))
        .join(F.broadcast(directory), "slot")  # at most 2**MAX_DEPTH slots
        .groupBy("bucket", "key", "norm")
        .agg(F.count(F.lit(1)).alias("group_size"))
        .select("bucket", "key", F.unhex(F.sha2("norm", 256)).alias("sha"), "group_size")
    ).join(slim.groupBy("key", "sha").agg(F.min(best).alias("best")), ["key", "sha"])
    index = shared_table(claims.repartitionByRange("bucket", "key").sortWithinPartitions("bucket", "key", "sha"), "exact-index")
    # chains: hashes that more than one text has
    chained = index.groupBy("key").agg(F.count(F.lit(1)).alias("links"), F.sort_array(F.collect_set("sha")).alias("shas")).where("links > 1")
    index = (
        index.join(chained, "key", "left")
        .withColumn("link", F.coalesce(F.array_position("shas", F.col("sha")).cast("int") - 1, F.lit(0)))
        .select("bucket", "key", "sha", F.col("best.doc_id").alias("keep_id"), (-F.col("best.n")).alias("keep_n"), "group_size", "link")
    )
    index = shared_table(index, "exact-chains")
    total = slim.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    large = max(1.0, total * HOT_SHARE)  # fewer than 1 / HOT_SHARE groups are larger
    hot, cold = index.where(F.col("group_size") > large), index.where(F.col("group_size") <= large)
    found = slim.join(F.broadcast(hot), ["key", "sha"]).unionByName(
        slim.join(F.broadcast(hot.select("key", "sha")), ["key", "sha"], "left_anti").join(cold, ["key", "sha"])
    )
    winner = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n"))
    return found.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select(
        "doc_id", "keep_id", "group_size",
        (winner & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "bucket", "link",
    )
