"""Near-duplicate documents by ProbMinHash, banding and verification.

A text's shingles are runs of five words (lower case; a text of fewer words is
one shingle).  Every shingle is a Poisson process whose rate is its weight: its
arrivals, drawn from its hash, hit random registers, and a register keeps the
shingle that arrived first.  A shingle whose next arrival comes later than the
latest register is finished.  Two documents agree in a register with the
probability Jaccard similarity of their weights.  Links are defined on sets, so
every shingle weighs 1, however often it occurs: that similarity is then the
Jaccard similarity of the sets, and repetitions hide no pair.  Bands of
registers are hashed into buckets.

1. Documents of the same words in the same order are one node.
2. A node's shingles that no other node of a bucket of two or more has cannot
   be shared with a partner.  They bound every similarity from above; a node
   or pair whose bound is below the threshold is left out, which loses nothing.
3. In each bucket three nodes are centres (the one whose buckets hold most, and
   two by chance) and every other is compared with them: the exact Jaccard
   similarity of the shingle sets must reach the threshold.  Links make classes.
4. In a bucket of several classes, the nodes outside its largest class are
   compared with all nodes of the bucket that are of another class, in blocks
   of queries that return links only.  So of each pair of a bucket either both
   are in one class already or it has been compared: no link between
   candidates is lost, but a group of many near copies needs a few rows a
   member, not a row a pair.
5. Classes are the connected components of the links.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table, ship_package, slices, text_of
from .graph import components

SHINGLE_WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 16, 4  # found with probability 0.9998 at similarity 0.8
BLOCK = 32  # nodes that a row of step 4 compares a node with
MEMO_WORDS = 400_000
_WORD = re.compile(r"\w+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

_words: dict[str, int] = {}


def mixed(x: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit mix of ``x``, another one for each ``k``."""
    x = x + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def shingles(words: list[str], size: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct 64-bit shingles of a text's words."""
    if not words:
        return np.empty(0, np.uint64)
    ids = list(map(_words.get, words))
    if None in ids:
        if len(_words) > MEMO_WORDS:
            _words.clear()
        ids = [_words.setdefault(w, xxhash.xxh64_intdigest(w)) if i is None else i for w, i in zip(words, ids)]
    ids = np.array(ids, np.uint64)
    size = min(size, len(ids))
    h = np.full(len(ids) - size + 1, np.uint64(size))
    for k in range(size):
        h = h * _MULTIPLIER + ids[k : len(ids) - size + 1 + k]
        h ^= h >> np.uint64(29)
    return np.unique(h)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """The ProbMinHash signatures of (shingles, weights) sets, none empty."""
    d = np.repeat(np.arange(len(sets)), [len(s) for s, _ in sets])
    h = np.concatenate([s for s, _ in sets])
    w = np.concatenate([x for _, x in sets])
    first, holder = np.full(len(sets) * registers, np.inf), np.zeros(len(sets) * registers, np.uint64)
    t, k = np.zeros(len(h)), 0
    while len(h):
        u = ((mixed(h, 2 * k) >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)
        t = t - np.log(u) / w
        slot = d * registers + (mixed(h, 2 * k + 1) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, slot, t)
        won = first[slot] == t
        holder[slot[won]] = h[won]
        latest = first.reshape(len(sets), registers).max(axis=1)
        on = t < latest[d]
        d, h, w, t, k = d[on], h[on], w[on], t[on], k + 1
    return holder.reshape(len(sets), registers)


def buckets(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit bucket for each band of each signature."""
    cut = signature.reshape(len(signature), bands, rows)
    h = np.broadcast_to(mixed(np.arange(bands, dtype=np.uint64), 0), cut.shape[:2]).copy()
    for r in range(rows):
        h = mixed(h ^ cut[:, :, r], r + 1)
    return h


def _signed(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            words = [words_of(t) for t in texts]
            sets = [shingles(w, size) for w in words]
            some = [i for i, w in enumerate(words) if w]
            found: list = [None] * len(words)
            if some:
                signature = signatures([(sets[i], np.ones(len(sets[i]))) for i in some], bands * rows)
                for i, x in zip(some, buckets(signature, bands, rows).view(np.int64)):
                    found[i] = x
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(2),
                    pa.array([xxhash.xxh3_128_digest(" ".join(w) or t) if t else None for w, t in zip(words, texts)], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(found, pa.list_(pa.int64())),
                ],
                ["doc_id", "text_hash", "words_key", "n", "buckets"],
            )

    return run


def _shingled(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            words = [words_of(t) for t in b.column(2).to_pylist()]
            same = [i for i, (w, k) in enumerate(zip(words, b.column(1).to_pylist())) if xxhash.xxh3_128_digest(" ".join(w)) == k]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(same, pa.int64())), pa.array([shingles(words[i], size).view(np.int64) for i in same], pa.list_(pa.int64()))],
                ["node", "shingles"],
            )

    return run


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, class_size, kept``.
    Options: ``threshold``, ``shingle_words``, ``bands`` and ``rows``.

    Texts are linked when the Jaccard similarity of their sets of five-word
    shingles is at least the threshold; a class is a connected component.
    ``class_id`` is the smallest id in it (null only if all are null); a row of
    that id is ``kept``, one if there are several.  Texts without any word are
    one class where they are equal; a null or empty text is a class of its own,
    together with repetitions of the same row.  An empty table gives no rows.
    """
    return _classified(docs, **options).drop("text_hash")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that ``near_duplicates`` keeps, with all their
    columns; of identical rows one."""
    kept = _classified(docs, **options).where("kept")
    kept = kept.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("k1"), F.col("doc_id").isNull().alias("k2"), F.col("text_hash").alias("k3"))
    id_ = F.col("doc_id").cast("long")
    keyed = docs.select(F.struct("*").alias("row"), F.coalesce(id_, F.lit(0).cast("long")).alias("k1"), id_.isNull().alias("k2"), F.xxhash64(text_of()).alias("k3"))
    found = keyed.join(kept, ["k1", "k2", "k3"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("k1", "k2", "k3").orderBy("k3"))
    return found.withColumn("nth", nth).where("nth = 1").select("row.*")


def _classified(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    shingle_words: int = SHINGLE_WORDS,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """``near_duplicates`` with the hash of each row's text."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.xxhash64(text_of()).alias("text_hash"))
    signed = texts.mapInArrow(_signed(shingle_words, bands, rows), "doc_id long, text_hash long, words_key binary, n int, buckets array<long>")
    signed = shared_table(signed, "signed")

    # nodes: distinct word sequences, each with one of its rows
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    nodes = signed.where("n > 0").groupBy("words_key").agg(F.min(row).alias("row"), F.first("n").alias("n"), F.first("buckets").alias("buckets"))
    nodes = shared_table(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    filed = nodes.select("node", "n", F.explode("buckets").alias("bucket"))
    shared = filed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = shared_table(filed.join(shared, "bucket"), "members")

    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select(
        "node", "words_key", F.col("row.doc_id").alias("rep_id"), F.col("row.text_hash").alias("rep_hash")
    )
    same = texts["doc_id"].eqNullSafe(wanted["rep_id"]) & (texts["text_hash"] == wanted["rep_hash"])
    chosen = texts.join(wanted, same).select("node", "words_key", "text")
    sets = chosen.mapInArrow(_shingled(shingle_words), "node long, shingles array<long>")
    sets = shared_table(sets.dropDuplicates(["node"]), "shingles")  # a repeated row gives its set again

    # shingles that no other node has cannot be shared with a partner
    owners = sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("node"))
    alone = owners.where("c = 1").groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
    stats = degree.join(alone, "node", "left")
    members = members.drop("size").join(stats, "node").withColumn("common", F.col("n") - F.coalesce("alone", F.lit(0)))
    members = shared_table(members.where(F.col("common") >= threshold * F.col("n")).drop("alone"), "members")
    # centres of a bucket: the node whose buckets together hold most, and two by chance, others in each bucket
    at = lambda *order: F.struct(*order, F.struct("node", "n", "common").alias("c"))
    chance = at(F.xxhash64("node", "bucket"))
    three = members.groupBy("bucket").agg(F.max(at("degree", "node"))["c"].alias("x"), F.min(chance)["c"].alias("y"), F.max(chance)["c"].alias("z"))
    centres = three.select("bucket", F.explode(F.array_distinct(F.array("x", "y", "z"))).alias("c"))
    centres = centres.select("bucket", F.col("c.node").alias("c_node"), F.col("c.n").alias("c_n"), F.col("c.common").alias("c_common"))

    def linked(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        near = both >= threshold * (F.size("x") + F.size("y") - both) - 1e-9
        return shared_table(pairs.join(left, "a").join(right, "b").where(near).select("a", "b"), "links")

    def fit(n: Column, common: Column, m: Column, other: Column) -> Column:
        """Necessary for a link: sizes alike, and enough shingles that are not alone."""
        alike = F.least(n, m) >= threshold * F.greatest(n, m)
        return alike & (F.least(common, other) * (1 + threshold) >= threshold * (n + m) - 1e-9)

    near = fit(F.col("n"), F.col("common"), F.col("c_n"), F.col("c_common"))
    against = members.join(centres, "bucket").where((F.col("node") != F.col("c_node")) & near)
    pairs = against.select(F.least("node", "c_node").alias("a"), F.greatest("node", "c_node").alias("b")).distinct()
    links = linked(shared_table(pairs, "pairs"))
    labels = shared_table(components(links), "labels")

    # buckets of several classes: what is not of the largest one is compared with the whole bucket, in blocks
    now = members.join(labels, "node", "left").select("bucket", "node", "n", "common", F.coalesce("component", "node").alias("class"))
    sizes = now.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("size")).groupBy("bucket").agg(
        F.max(F.struct("size", "class")).alias("most"), F.sum("size").alias("all")
    )
    open_ = sizes.where(F.col("all") > F.col("most.size")).select(
        "bucket", F.col("most.class").alias("main"), F.ceil((F.col("all") - F.col("most.size")) / BLOCK).alias("blocks")
    )
    rows_ = shared_table(now.join(open_, "bucket").join(sets, "node"), "open")
    rest = rows_.where("class <> main").groupBy("bucket", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block")).agg(
        F.collect_list(F.struct("node", "n", "common", "class", "shingles")).alias("queries")
    )  # about BLOCK of them

    def hit(q: Column) -> Column:
        both = F.size(F.array_intersect(q["shingles"], F.col("shingles")))
        other = (q["class"] != F.col("class")) & fit(q["n"], q["common"], F.col("n"), F.col("common"))
        return F.when(other, both >= threshold * (q["n"] + F.col("n") - both) - 1e-9).otherwise(F.lit(False))

    hits = rows_.join(rest, "bucket").select("node", F.explode(F.transform(F.filter("queries", hit), lambda q: q["node"])).alias("other"))
    more = shared_table(hits.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    named = nodes.select("node", "words_key").join(labels, "node", "left").select("words_key", F.coalesce("component", "node").alias("class"))
    # equal rows travel as one with their number
    slim = signed.groupBy("doc_id", "text_hash", "words_key", (F.col("n") > 0).alias("some")).agg(F.count(F.lit(1)).alias("times"))
    some = shared_table(slim.where("some").join(named, "words_key"), "classified")
    # the smallest id stays, of several texts that have it one
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "words_key", "text_hash")

    def placed(rows: DataFrame, key: str) -> DataFrame:
        classes = rows.groupBy(key).agg(F.min(row).alias("keep"), F.sum("times").alias("class_size"))
        return rows.join(classes, key).select(
            "doc_id", "text_hash", F.col("keep.doc_id").alias("class_id"), "class_size", "times", row.eqNullSafe(F.col("keep")).alias("first")
        )

    wordless = slim.where(~F.col("some") & F.col("words_key").isNotNull())  # keyed by the text
    none = slim.where(F.col("words_key").isNull()).select(
        "doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.col("times").alias("class_size"), "times", F.lit(True).alias("first")
    )
    return (
        placed(some, "class").unionByName(placed(wordless, "words_key")).unionByName(none)
        .withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
        .select("doc_id", "text_hash", "class_id", "class_size", (F.col("first") & (F.col("nth") == 1)).alias("kept"))
    )
