"""The vector index finds what comparing with every vector finds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from redline.operators import vector_index
from redline.operators.vector_index import nearest_vectors

VECTORS = "{} long, embedding array<float>"


def best(a, b):
    """Cosine of float products, summed as doubles."""
    a, b = np.float32(a), np.float32(b)
    total = lambda x, y: float((x * y).astype(float).sum())
    return total(a, b) / (total(a, a) ** 0.5 * total(b, b) ** 0.5) if np.any(a) and np.any(b) else 0.0


@pytest.mark.parametrize("cells, probes", [(1, 1), (8, 1), (64, 2)])
def test_equals_every_pair(spark, monkeypatch, cells, probes):
    monkeypatch.setattr(vector_index, "PART", 16)  # cells of several parts
    rng = np.random.default_rng(cells)
    centres = rng.normal(size=(6, 12)) * 4
    rows = [(i, (centres[i % 6] + rng.normal(size=12) * (0.1 if i % 3 else 2)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)] + [(2000, [0.0] * 12), (2001, None), (2002, [1.0, None] + [0.0] * 10), (2003, [1.0])]
    asked = [(i, (centres[i % 6] + rng.normal(size=12)).astype(np.float32).tolist()) for i in range(50)]
    asked += [(100, rows[5][1]), (101, [0.0] * 12), (102, None), (103, [1.0]), (None, rows[7][1]), (7, rows[9][1])]
    got = nearest_vectors(spark.createDataFrame(asked, VECTORS.format("q")).repartition(3), spark.createDataFrame(rows, VECTORS.format("c")), "q", "c", cells=cells, probes=probes)
    found = [(r.q, r.match and (r.match.c, r.match.score)) for r in got.collect()]
    assert len(found) == len(asked)
    sound = [(i, v) for i, v in rows if v and len(v) == 12 and None not in v]
    want = []
    for q, v in asked:
        scores = [] if not v or len(v) != 12 else [(-round(best(v, c), 9), i) for i, c in sound]
        want.append((q, min(scores)[1] if scores else None, -min(scores)[0] if scores else None))
    simple = sorted(((q, m and m[0], m and round(m[1], 9)) for q, m in found), key=str)
    assert simple == sorted(((q, c, s if s is None else s + 0.0) for q, c, s in want), key=str)


def test_no_candidates(spark):
    queries = spark.createDataFrame([(1, [1.0, 2.0])], VECTORS.format("q"))
    none = spark.createDataFrame([], VECTORS.format("c"))
    assert [tuple(r) for r in nearest_vectors(queries, none, "q", "c").collect()] == [(1, None)]
    assert nearest_vectors(queries.where(F.lit(False)), none, "q", "c").count() == 0
