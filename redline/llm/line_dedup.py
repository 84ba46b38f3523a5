"""Repeated line runs, found by a suffix array over line ids.

All lines of all documents form one sequence in order of ``doc_id``; a line's
place in it is a long (per-partition totals of the line counts, summed up,
give each document its first place).  A run of consecutive lines of one
document is deleted where the same run stands earlier in the sequence, if it
has at least ``min_words`` words.

The suffix array is built by prefix doubling over the places that still
matter, each round a join and a grouping over slim rows.  In round ``k`` every
place carries the name of its first ``2**k`` lines; two names, of a place and
of the one ``2**k`` further, give the name of twice as many lines.  A name is
the smallest place of its interval of suffixes with that common prefix, so it
says at once where the first copy is, and a place alone in its interval drops
out (its suffix is told from all others).

The longest common prefixes that matter are those of ``min_words`` words: from
each place the shortest run that long, and for each place the shortest run
that ends there.  A window of ``m`` lines is named by the two blocks of
``2**k <= m`` lines that cover it; places with equal windows are an interval,
and all but its first are later copies.  The windows of a maximal repeated run
cover exactly its lines, however long it is, so doubling ends at ``min_words``
lines (a line counts as one word at least).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table, ship_package, slices, text_of

MIN_WORDS = 50


def windows(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line the number of lines from it on that hold ``least`` words,
    and of those that end with it; 0 where there are not so many."""
    n = len(words)
    before = np.concatenate([[0], np.cumsum(words)])
    end = np.searchsorted(before, before[:-1] + least)  # before[end] - before[i] >= least
    start = np.searchsorted(before, before[1:] - least, "right") - 1  # before[i + 1] - before[start] >= least
    i = np.arange(n)
    return np.where(end <= n, end - i, 0), np.where(start >= 0, i + 1 - start, 0)


def _lines(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[list] = [[], [], [], []]
            for text in b.column(3).to_pylist():
                lines = text.split("\n")
                ahead, back = windows(np.array([max(1, len(x.split())) for x in lines]), least)
                for o, x in zip(out, (len(lines), [xxhash.xxh3_128_digest(x) for x in lines], ahead.astype(np.int32), back.astype(np.int32))):
                    o.append(x)
            kinds = (pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], *(pa.array(o, k) for o, k in zip(out, kinds))], ["doc_id", "text_hash", "tie", "n", "ids", "ahead", "back"]
            )

    return run


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The lines to delete: ``doc_id, text_hash, nth, line`` (``nth`` tells
    rows of equal id and text apart, from 1; ``line`` counts from 0)."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_hash"), F.monotonically_increasing_id().alias("tie"), text_of().alias("text"))
    lined = rows.mapInArrow(_lines(min_words), "doc_id long, text_hash long, tie long, n long, ids array<binary>, ahead array<int>, back array<int>")
    order = [F.col("doc_id").asc_nulls_last(), "text_hash", "tie"]
    lined = shared_table(lined, "lines")
    ranged = lined.select("doc_id", "text_hash", "tie", "n").repartitionByRange(*order)
    ranged = shared_table(ranged.withColumn("part", F.spark_partition_id()), "ranges")

    totals = ranged.groupBy("part").agg(F.sum("n").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = ranged.select("doc_id", "text_hash", "tie", "part", "n", F.sum("n").over(inside).alias("upto"))
    first = first.join(F.broadcast(offsets), "part").select("doc_id", "text_hash", "tie", (F.col("before") + F.col("upto") - F.col("n")).alias("first"))
    first = first.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id", "text_hash").orderBy("tie")).cast("long"))
    first = shared_table(first, "places")  # document, first place

    lines = lined.join(first.select("tie", "first"), "tie").select(
        "first", "n", F.posexplode(F.arrays_zip("ids", "ahead", "back")).alias("line", "x")
    )
    lines = lines.select((F.col("first") + F.col("line")).alias("g"), F.col("x.ids").alias("id"), (F.col("n") - F.col("line")).alias("left"), F.col("x.ahead").alias("ahead"), F.col("x.back").alias("back"))
    lines = shared_table(lines, "line-places")

    names = lines.groupBy("id").agg(F.min("g").alias("name"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    named = lines.join(names, "id").select("g", "name", "left", "ahead", "back")  # round 0: one line
    named = shared_table(named, "suffixes")
    wanted = named.where("ahead > 0").select("g", F.col("ahead").alias("m")).unionByName(
        named.where("back > 0").select((F.col("g") - F.col("back") + 1).alias("g"), F.col("back").alias("m"))
    )
    wanted = shared_table(wanted.distinct(), "windows")

    copies = [wanted.where("m = 1").join(named, "g").where("g > name").select("g", "m")]
    size, places = 1, named.select("g", "name", "left")
    while True:
        if size > 1:  # windows of size .. 2 * size - 1 lines
            here = wanted.where(F.col("m").between(size, 2 * size - 1))
            blocks = here.join(places.select("g", F.col("name").alias("a")), "g")
            blocks = blocks.withColumn("g2", F.col("g") + F.col("m") - size).join(places.select(F.col("g").alias("g2"), F.col("name").alias("b")), "g2")
            blocks = shared_table(blocks.select("g", "m", "a", "b"), "blocks")
            heads = blocks.groupBy("m", "a", "b").agg(F.min("g").alias("head"), F.count(F.lit(1)).alias("c")).where("c > 1")
            copies.append(blocks.join(heads, ["m", "a", "b"]).where("g > head").select("g", "m"))
        if 2 * size > min_words:
            break
        further = places.select((F.col("g") - size).alias("g"), F.col("name").alias("b"))
        pairs = places.where(F.col("left") >= 2 * size).withColumnRenamed("name", "a").join(further, "g")
        pairs = shared_table(pairs, "pairs")
        twice = pairs.groupBy("a", "b").agg(F.min("g").alias("name"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
        places = shared_table(pairs.join(twice, ["a", "b"]).select("g", "name", "left"), "suffixes")
        size *= 2
        if places.isEmpty():
            break
    found = copies[0]
    for c in copies[1:]:
        found = found.unionByName(c)
    gone = found.select(F.explode(F.sequence(F.col("g"), F.col("g") + F.col("m") - 1)).alias("g")).distinct()
    spans = lined.select("tie", "n").join(first, "tie").select("doc_id", "text_hash", "nth", F.posexplode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("line", "g"))
    return spans.join(gone, "g").select("doc_id", "text_hash", "nth", "line")


def _without(texts: pd.Series, lines: pd.Series) -> pd.Series:
    def cut(text, gone):
        if text is None or gone is None:
            return None
        gone = set(gone.tolist())
        return "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)

    return pd.Series([cut(t, g) for t, g in zip(texts, lines)])


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, stats: str = "line_stats") -> DataFrame:
    """``docs`` without the later copies of repeated line runs.

    Returns the rows with all their columns, ``text`` cut and ``n_chars`` (if
    there) counted anew where lines went, and a struct named ``stats`` with
    ``lines`` and ``deleted`` (numbers of lines).
    The first copy is that of the smallest ``doc_id`` (null last), then of the
    smallest digest of the text; of identical rows the first stays whole.  A
    null text stays null and an empty one empty (one line without words).  A
    row all of whose lines were later copies keeps an empty text.
    """
    gone = repeated_runs(docs, min_words)
    gone = gone.groupBy("doc_id", "text_hash", "nth").agg(F.collect_list("line").alias("lines"))
    gone = gone.groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("nth", "lines"))).alias("gone"))
    gone = gone.select(F.coalesce("doc_id", F.lit(0)).alias("k1"), F.col("doc_id").isNull().alias("k2"), F.col("text_hash").alias("k3"), "gone")
    id_ = F.col("doc_id").cast("long")
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(id_, F.lit(0).cast("long")).alias("k1"), id_.isNull().alias("k2"), F.xxhash64(text_of()).alias("k3"))
    found = keyed.join(gone, ["k1", "k2", "k3"], "left")
    nth = F.row_number().over(Window.partitionBy("k1", "k2", "k3").orderBy("k3")).cast("long")
    found = found.withColumn("gone", F.col("gone")[nth])
    text = F.col("row.text")
    without = F.pandas_udf(_without, "string")
    found = found.withColumn("cut", without(F.when(F.col("gone").isNotNull(), text), "gone"))
    found = found.withColumn("new", F.coalesce("cut", text))
    found = found.withColumn("stats", F.struct(F.size(F.split(text_of(text), "\n", -1)).alias("lines"), F.coalesce(F.size("gone"), F.lit(0)).alias("deleted")))
    new = {"text": F.col("new"), "n_chars": F.when(F.col("gone").isNotNull(), F.char_length("new").cast(dict(docs.dtypes).get("n_chars", "long"))).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns], F.col("stats").alias(stats))
