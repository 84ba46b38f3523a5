"""Merkle manifest of a table, verified by a recursive query.

``H`` is the lowercase hex SHA-256 of its inputs' concatenation (digests as
hex text; tables keep the 32 bytes).  A row is a leaf: ``H`` of its fields.
The leaves of a source, ascending by id, are the lowest level of a tree:
every ``FAN`` consecutive nodes become their ``H`` until one, the subroot, is
left; the subroots, in the order of the sources, give the root likewise.

Building.  The leaves are written, range-partitioned by (source, id) and
written again with the number of their partition.  Counts per (partition,
source) give each leaf its rank in its source and its global position, so a
source that holds most rows is spread over many tasks.  A level is one
grouping by run (at most ``FAN`` rows each), written to the shared folder; a
level has a ``FAN``-th of the rows of the one below.

Stored runs.  A run of siblings is a row: ``run`` (its key), ``digests`` of its
nodes in order, and the link to where its own digest stands: ``parent`` (the
run above) and ``pos`` in it, null at the root.

Climbing.  A Spark recursive query ascends from the leaves by ``parent``.  Its
rows are the lowest runs, since the up to ``FAN`` leaves of a run share their
whole path: a row holds the folded hash of each of its leaves and the siblings
met so far.  One step joins the run above, appends the siblings and folds each
hash with them.  Near the root all rows meet the same runs, so runs are
repeated for each block of ``BLOCK`` leaf positions that they cover, and the
join is by (run, block): no key has more than ``BLOCK / FAN`` rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_table

FAN = 16
#: Leaf positions that share a copy of a run.
BLOCK = 1 << 14
#: Bytes of a digest.
SIZE = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels of the tree over the subroots are numbered from here.
TOP = 64


def field(value: Column) -> Column:
    """``-`` for null, else UTF-8 byte count, ``:``, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[field(v) for v in values]), 256))


def as_hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def joined(digests: Column) -> Column:
    """An array of digests as one binary."""
    return F.aggregate(digests, F.lit(b"").cast("binary"), lambda acc, d: F.concat(acc, d))


def hashed(binary: Column) -> Column:
    """``H`` of concatenated digests."""
    return F.unhex(F.sha2(as_hex(binary), 256))


def before(digests: Column, pos: Column) -> Column:
    """The joined digests to the left of the one at ``pos``."""
    return F.substring(digests, F.lit(1), pos * SIZE)


def after(digests: Column, pos: Column) -> Column:
    return F.substring(digests, (pos + 1) * SIZE + 1, F.length(digests))


def numbered(rows: DataFrame, name: str, group: list[str], order: list[str], tie: list[str]) -> DataFrame:
    """``rows`` with ``rank`` (from 0 in their group), ``first`` (the position of
    the group's first row in the order of all rows) and ``m`` (rows in the
    group).  Nulls come first and are a group."""
    ranged = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order, *tie)
    rows = shared_table(ranged.withColumn("part", F.spark_partition_id()), name)
    counts = shared_table(rows.groupBy("part", *group).agg(F.count(F.lit(1)).alias("n")), f"{name}-counts")
    earlier = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = counts.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy(*group).rowsBetween(Window.unboundedPreceding, -1)
    # only the first group of a partition can have rows in earlier ones
    places = (
        counts.withColumn("carried", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .withColumn("m", F.sum("n").over(Window.partitionBy(*group)))
        .withColumn("in_part", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(starts, "part")
        .select(
            F.col("part").alias("_part"), *[F.col(g).alias(f"_{g}") for g in group], "carried", "m",
            (F.col("start") + F.col("in_part") - F.col("carried")).alias("first"),
        )
    )
    nth = Window.partitionBy("part", *group).orderBy(*order, *tie)
    on = F.col("part") == F.col("_part")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_{g}"))
    return (
        rows.withColumn("nth", F.row_number().over(nth) - 1)
        .join(places, on)
        .withColumn("rank", F.col("nth") + F.col("carried"))
        .drop("nth", "carried", "part", "_part", *[f"_{g}" for g in group])
    )


@dataclass
class Manifest:
    """``leaf_runs``: the lowest runs with their leaves; ``runs``: all runs above
    them; ``root``: one row (hex), none for an empty table."""

    leaf_runs: DataFrame
    runs: DataFrame
    root: DataFrame


RUN = "run long, digests binary, parent long, pos int, subroot binary, lo long, hi long"


def _levels(most: int) -> int:
    """Groupings until one node is left of ``most``."""
    n = 0
    while most > 1:
        most, n = -(-most // FAN), n + 1
    return n


def _linked(runs: DataFrame, level: int, base: int) -> DataFrame:
    """Keys of the runs of a level (``tree``, ``rank``, ``m`` runs in the tree) and
    of the runs above them.  A key is unique by level and beginning."""

    def key(rank: Column, at: int) -> Column:
        return (F.col("tree") + rank * F.lit(FAN**at)) * 256 + (base + at)

    above = F.col("m") > 1
    return (
        runs.withColumn("run", key(F.col("rank"), level))
        .withColumn("parent", F.when(above, key(F.floor(F.col("rank") / FAN).cast("long"), level + 1)))
        .withColumn("pos", F.when(above, (F.col("rank") % FAN).cast("int")))
        .withColumn("last", ~above)
    )


def _grouped(nodes: DataFrame, *payload: str) -> DataFrame:
    """Nodes of one run (``FAN`` at most) as one row; ``m`` becomes the number of runs."""
    run_no = F.floor(F.col("rank") / FAN).cast("long").alias("run_no")
    grouped = nodes.groupBy("tree", run_no, "m").agg(
        F.sort_array(F.collect_list(F.struct("rank", "digest", *payload))).alias("nodes"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    return grouped.select(
        "tree", F.col("run_no").alias("rank"), F.ceil(F.col("m") / FAN).cast("long").alias("m"), (F.col("m") == 1).alias("lone"), "nodes", "lo", "hi"
    )


def _tree(nodes: DataFrame, first_level: int, levels: int, name: str, base: int = 0) -> list[DataFrame]:
    """The runs above ``nodes`` (tree, rank, m, digest, lo, hi), a table a level."""
    out = []
    for level in range(first_level, levels + 1):
        made = _grouped(nodes.where("m > 1")).withColumn("digests", joined(F.col("nodes.digest"))).withColumn("digest", hashed(F.col("digests")))
        nodes = shared_table(_linked(made, level, base).drop("nodes", "lone"), f"{name}-{level}")
        out.append(nodes)
    return out


def build_manifest(leaves: DataFrame) -> Manifest:
    """The tree over ``leaves`` (source, doc_id, leaf, tampered; both digests
    binary, ``tampered`` null where it equals the leaf).

    Rows of one id stand in the order of their leaves; null ids and the null
    source come first; repeated rows are leaves of their own.
    """
    spark = leaves.sparkSession
    placed = shared_table(numbered(leaves, "merkle-leaves", ["source"], ["doc_id"], ["leaf"]), "merkle-placed")
    most = placed.agg(F.max("m")).first()[0] or 0
    at = F.col("first") + F.col("rank")
    nodes = placed.select("doc_id", "tampered", "rank", "m", F.col("first").alias("tree"), F.col("leaf").alias("digest"), at.alias("lo"), at.alias("hi"))
    # a lone leaf is its source's subroot; any other run becomes its hash
    lowest = _grouped(nodes, "doc_id", "tampered").withColumn(
        "digest", F.when(F.col("lone"), F.col("nodes")[0]["digest"]).otherwise(hashed(joined(F.col("nodes.digest"))))
    )
    lowest = shared_table(_linked(lowest, 1, 0), "merkle-1")
    upper = _tree(lowest, 2, _levels(most), "merkle")

    # the subroots, in the order of the sources, are the leaves of the top tree
    ends = [t.where("last").select("tree", "digest", "lo", "hi") for t in [lowest, *upper]]
    subroots = ends[0]
    for t in ends[1:]:
        subroots = subroots.unionByName(t)
    ranked = shared_table(numbered(subroots.withColumn("all", F.lit(0)), "merkle-subroots", ["all"], ["tree"], []), "merkle-ranked")
    sources = ranked.agg(F.max("m")).first()[0] or 0
    top = _tree(ranked.withColumn("tree", F.lit(0).cast("long")), 1, _levels(sources), "merkle-top", TOP)
    root = (top[-1] if top else ranked).select(as_hex(F.col("digest")).alias("root"))  # its last level is one run

    place = ranked.select(F.col("tree").alias("of"), "rank", "m", F.col("digest").alias("subroot")).withColumn("tree", F.lit(0).cast("long"))
    place = _linked(place, 0, TOP).select("of", "subroot", "parent", "pos")  # of a subroot, as a node of the top tree

    def climbable(runs: DataFrame) -> DataFrame:
        inner = runs.where("NOT last").withColumn("subroot", F.lit(None).cast("binary"))
        outer = runs.where("last").drop("parent", "pos").join(place, F.col("tree") == F.col("of")).drop("of")
        return inner.unionByName(outer)

    names = [c.split()[0] for c in RUN.split(", ")]
    runs = spark.createDataFrame([], RUN)
    for t in upper:
        runs = runs.unionByName(climbable(t).select(*names))
    for t in top:
        runs = runs.unionByName(t.withColumn("subroot", F.lit(None).cast("binary")).select(*names))
    return Manifest(climbable(lowest), shared_table(runs, "merkle-runs"), root)


CLIMB = """
WITH RECURSIVE climb (run, block, parent, pos, subroot, folded, siblings) AS (
    SELECT run, block, parent, pos, subroot, folded, siblings FROM {start}
  UNION ALL
    SELECT c.run, c.block, r.parent, r.pos, coalesce(c.subroot, r.subroot),
           transform(c.folded, node -> unhex(sha2(lower(hex(concat(
             substring(r.digests, 1, c.pos * 32), node, substring(r.digests, c.pos * 32 + 33)))), 256))),
           concat(c.siblings, substring(r.digests, 1, c.pos * 32), substring(r.digests, c.pos * 32 + 33))
    FROM climb c JOIN {runs} r ON c.parent = r.run AND c.block = r.block
)
SELECT run, subroot, folded, siblings FROM climb WHERE parent IS NULL
"""


def climb(manifest: Manifest) -> DataFrame:
    """Per lowest run: the subroot, each leaf's hash folded up to the root, and
    the siblings above the run, level by level (binary)."""
    spark = manifest.runs.sparkSession
    block = F.floor(F.col("lo") / BLOCK).cast("long")
    digests = joined(F.col("nodes.digest"))
    changed = F.transform("nodes", lambda n: F.coalesce(n["tampered"], n["digest"]))
    folded = F.when(F.col("lone"), F.col("changed")).otherwise(
        F.transform("changed", lambda node, i: hashed(F.concat(before(F.col("digests"), i), node, after(F.col("digests"), i))))
    )
    start = (
        manifest.leaf_runs.withColumn("digests", digests)
        .withColumn("changed", changed)
        .select("run", block.alias("block"), "parent", "pos", "subroot", folded.alias("folded"), F.lit(b"").cast("binary").alias("siblings"))
    )
    blocks = F.sequence(F.floor(F.col("lo") / BLOCK).cast("long"), F.floor(F.col("hi") / BLOCK).cast("long"))
    runs = manifest.runs.select("run", "digests", "parent", "pos", "subroot", F.explode(blocks).alias("block"))
    runs = shared_table(runs, "merkle-blocks")
    limit = "spark.sql.cteRecursionRowLimit"  # counts the rows of all steps
    held = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        return shared_table(spark.sql(CLIMB.format(start="{start}", runs="{runs}"), start=shared_table(start, "merkle-start"), runs=runs), "merkle-climbed")
    finally:
        spark.conf.set(limit, held)


def verify(manifest: Manifest) -> DataFrame:
    """A row a leaf: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (``H``
    of its siblings up to the root), ``folded_root`` (from the tampered leaf, or
    the leaf itself) and ``verified``."""
    climbed = climb(manifest).withColumnRenamed("run", "of")
    rows = (
        manifest.leaf_runs.select("run", "nodes")
        .join(climbed, F.col("run") == F.col("of"))
        .withColumn("digests", joined(F.col("nodes.digest")))
        .select("digests", "subroot", "folded", "siblings", F.posexplode("nodes").alias("at", "node"))
    )
    proof = F.concat(before(F.col("digests"), F.col("at")), after(F.col("digests"), F.col("at")), F.col("siblings"))
    root = F.broadcast(manifest.root)  # one row
    return rows.join(root).select(
        F.col("node.doc_id").alias("doc_id"),
        as_hex(F.col("node.digest")).alias("leaf"),
        as_hex(F.col("subroot")).alias("subroot"),
        "root",
        F.sha2(as_hex(proof), 256).alias("proof_sha256"),
        as_hex(F.col("folded")[F.col("at")]).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z, and nothing else, in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def document_leaves(docs: DataFrame) -> DataFrame:
    """Leaves of ``docs`` by ``FIELDS``.  Tampered are rows whose id's CRC (of the
    decimal id) 5 divides: A-Z of the text become lower case; a null id or text
    stays as it is."""
    values = [F.col(c) for c in FIELDS]
    changed = (F.crc32(F.col("doc_id").cast("string")) % 5 == 0) & (lower_ascii(F.col("text")) != F.col("text"))
    return docs.select("source", "doc_id", leaf_digest(values).alias("leaf"), F.when(changed, leaf_digest([*values[:-1], lower_ascii(F.col("text"))])).alias("tampered"))


def document_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` with each row's proof and its check after the
    tampering.  Nulls in any column have a digest of their own; an empty table
    gives no rows; columns other than ``FIELDS`` are not read."""
    # written first: the range partitioning reads the digests twice, the texts once
    return verify(build_manifest(shared_table(document_leaves(docs), "merkle-hashed")))
