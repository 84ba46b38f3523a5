"""Cosine retrieval over many vectors: cells with angle bounds, exact top-1.

The index.  Equal vectors are one candidate (the first by its key).  Every
vector goes to the nearest of at most ``cells`` pivots, a sample by hash; a cell
knows the largest angle of its vectors to the pivot.  Cells are cut into parts
of about ``PART`` vectors, so one that holds most of them is many groups.

The search.  By the triangle inequality no vector of a cell is nearer to a
query than the query's angle to the pivot less the cell's largest angle.  A
query is compared with the ``PROBES`` most promising cells, then with every
other cell whose bound does not exclude a better answer: recall is 1 for any
data, and how many cells are left out depends on how the vectors cluster (of
directions without any cluster, none).  A part is compared with its queries as
one matrix product; what lies within ``SLACK`` of a query's best is scored again
by the same expression as in ``retrieve_top1``, which decides ties.

Pivots and cell bounds go through the driver: at most ``cells`` vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.policy import cosine_similarity
from ..session import materialize, ship_package

CELLS = 256
PART = 4096
PROBES = 2
SLACK = 1e-6


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, d)


def _angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(_unit(rows) @ pivots.T, -1.0, 1.0))


def _assigner(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                angle = _angles(_matrix(b.column("v"), pivots.shape[1]), pivots)
                cell = angle.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [b.column("cid"), b.column("v"), pa.array(cell, pa.int32()), pa.array(angle[np.arange(len(cell)), cell])], ["cid", "v", "cell", "angle"]
                )

    return run


def _bounder(pivots: np.ndarray, cells: np.ndarray, widest: np.ndarray):
    """Of each query: its cells, the most promising first, with the least angle possible there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                angle = _angles(_matrix(b.column("v"), pivots.shape[1]), pivots[cells])
                order = np.argsort(angle, axis=1, kind="stable")
                least = np.maximum(angle - widest, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [b.column("qid"), b.column("v"), pa.array(list(cells[order].astype(np.int32))), pa.array(list(np.take_along_axis(least, order, 1)))], ["qid", "v", "cells", "least"]
                )

    return run


def _compare(key: tuple[pa.Scalar, ...], queries: pa.Table, part: pa.Table) -> pa.Table:
    out: list[tuple[int, int, float]] = []
    if queries.num_rows and part.num_rows:
        v = part.column("v").combine_chunks()
        d = len(v[0])
        rows, cids = _unit(_matrix(v, d)), part.column("cid").to_numpy()
        qids = queries.column("qid").to_numpy()
        for at in range(0, len(qids), 1024):
            near = _unit(_matrix(queries.column("v").slice(at, 1024).combine_chunks(), d)) @ rows.T
            best = near.max(axis=1)
            for i, j in zip(*np.nonzero(near >= best[:, None] - SLACK)):
                out.append((int(qids[at + i]), int(cids[j]), float(near[i, j])))
    cols = list(zip(*out)) if out else [[], [], []]
    return pa.table({"qid": pa.array(cols[0], pa.int64()), "cid": pa.array(cols[1], pa.int64()), "near": pa.array(cols[2], pa.float64())})


def nearest_vectors(
    queries: DataFrame,
    candidates: DataFrame,
    query_key: str,
    candidate_key: str,
    vector: str = "embedding",
    cells: int = CELLS,
    probes: int = PROBES,
) -> DataFrame:
    """``query_key`` and ``match`` (``candidate_key`` and ``score``): the candidate of
    the largest cosine for every query row, the least key of several.

    Null vectors, those with a null entry and those of another length than the
    longest candidate are no candidates; such queries have a null match.  A zero
    vector has score 0 with all.  Repeated candidates count once.
    """
    spark = queries.sparkSession
    ship_package(spark)
    sound = F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    d = candidates.where(sound).agg(F.max(F.size(vector))).first()[0] or 0
    usable = sound & (F.size(vector) == d) & F.lit(d > 0)
    v = F.col(vector).cast("array<float>").alias("v")
    distinct = candidates.where(usable).select(v, F.col(candidate_key).alias("c_key")).groupBy("v").agg(F.min("c_key").alias("c_key"))
    rows = materialize(distinct.withColumn("cid", F.monotonically_increasing_id()))
    asked = materialize(queries.select(F.col(query_key).alias("q_key"), F.when(usable, F.col(vector).cast("array<float>")).alias("v")).withColumn("qid", F.monotonically_increasing_id()))
    sample = rows.orderBy(F.xxhash64("v"), "cid").limit(cells).select("v").collect()  # ``cells`` vectors
    kind = queries.schema[query_key].dataType
    if not sample:
        none = F.lit(None).cast(f"struct<{candidate_key}: {candidates.schema[candidate_key].dataType.simpleString()}, score: double>")
        return asked.select(F.col("q_key").cast(kind).alias(query_key), none.alias("match"))
    pivots = _unit(np.array([r["v"] for r in sample], float))

    placed = rows.select("cid", "v").mapInArrow(_assigner(pivots), "cid long, v array<float>, cell int, angle double")
    placed = materialize(placed)
    stats = placed.groupBy("cell").agg(F.max("angle").alias("widest"), F.count(F.lit(1)).alias("n")).orderBy("cell").collect()  # a row a cell
    used, widest = np.array([r["cell"] for r in stats]), np.array([r["widest"] for r in stats])
    parts = F.create_map(*[F.lit(int(x)) for r in stats for x in (r["cell"], -(-r["n"] // PART))])
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("cid"), parts[F.col("cell")].cast("long"))).select("cell", "part", "cid", "v")

    bounds = asked.where("v IS NOT NULL").select("qid", "v").mapInArrow(_bounder(pivots, used, widest), "qid long, v array<float>, cells array<int>, least array<double>")
    bounds = materialize(bounds)

    def compared(wanted: DataFrame) -> DataFrame:
        """``wanted``: qid, v, cell."""
        spread = wanted.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts[F.col("cell")].cast("long") - 1)))
        found = spread.groupBy("cell", "part").cogroup(dealt.groupBy("cell", "part")).applyInArrow(_compare, "qid long, cid long, near double")
        return found

    first = materialize(compared(bounds.select("qid", "v", F.explode(F.slice("cells", 1, probes)).alias("cell"))))
    best = first.groupBy("qid").agg(F.max("near").alias("best"))
    more = bounds.join(best, "qid").select("qid", "v", "best", F.posexplode(F.arrays_zip("cells", "least")).alias("at", "c"))
    more = more.where((F.col("at") >= probes) & (F.cos("c.least") >= F.col("best") - SLACK)).select("qid", "v", F.col("c.cells").alias("cell"))
    found = materialize(first.unionByName(compared(more)))
    top = found.groupBy("qid").agg(F.max("near").alias("top"))
    close = found.join(top, "qid").where(F.col("near") >= F.col("top") - SLACK).select("qid", "cid").distinct()
    scored = close.join(asked.select("qid", F.col("v").alias("qv")), "qid").join(rows, "cid")
    scored = scored.select("qid", F.struct((-cosine_similarity(F.col("qv"), F.col("v"))).alias("neg"), "c_key").alias("s")).groupBy("qid").agg(F.min("s").alias("s"))
    match = F.when(F.col("s").isNotNull(), F.struct(F.col("s.c_key").alias(candidate_key), (-F.col("s.neg")).alias("score")))
    return asked.join(scored, "qid", "left").select(F.col("q_key").alias(query_key), match.alias("match"))
