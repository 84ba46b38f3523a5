"""Extension points: detectors, value-entity detectors, embedders, reasoners.

* Detector (J1): ``Callable[[DataFrame], DataFrame]`` from ``sources`` to
  findings (contract schema).  Register with ``register_detector``; the
  registered detectors run in ``run_detectors`` and are unioned.
* Entity detector (J2): either ``Callable[[Column], Column]`` from the joined
  samples text to ``array<struct<cnt, neg_ord, category>>`` (the default is the
  offline pattern detector; pass it to ``scan_columns``), or a DataFrame hook
  adding ``entities array<struct<text, category, confidence>>`` for a ``text``
  column, which a remote service can be (``pandas_entities``); entities of too
  little confidence are left out, and where it fails (null) the column's name
  decides.
* Embedder (J3): ``Callable[[DataFrame], DataFrame]`` adding an
  ``embedding array<float>`` column for a ``text`` column — typically a
  ``mapInPandas`` over a model; used for clause vectors and query vectors.
* Reasoner (J4): ``Callable[[DataFrame], DataFrame]`` adding ``raw_1`` (and
  optionally ``raw_2``) answer texts; pass it to ``enrich``.  Remote calls
  belong inside ``mapInPandas``; bound the concurrency with the number of
  partitions (``repartition(n)`` before the hook).
"""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Detector = Callable[[DataFrame], DataFrame]
Embedder = Callable[[DataFrame], DataFrame]
Reasoner = Callable[[DataFrame], DataFrame]
EntityHook = Callable[[DataFrame], DataFrame]

_DETECTORS: dict[str, Detector] = {}


def register_detector(name: str, detector: Detector) -> None:
    _DETECTORS[name] = detector


def registered_detectors() -> dict[str, Detector]:
    return dict(_DETECTORS)


def run_detectors(sources: DataFrame, detectors: dict[str, Detector] | None = None) -> DataFrame | None:
    """Union of the findings of the given (or registered) detectors."""
    ds = detectors if detectors is not None else _DETECTORS
    out = None
    for fn in ds.values():
        f = fn(sources)
        out = f if out is None else out.unionByName(f)
    return out


def pandas_embedder(embed_batch: Callable[[list[str]], list[list[float]]], text_col: str = "text") -> Embedder:
    """An embedder from a batch function ``texts -> vectors`` run with
    ``mapInPandas`` (Arrow batches, one model load per task)."""

    def hook(df: DataFrame) -> DataFrame:
        schema = T.StructType(df.schema.fields + [T.StructField("embedding", T.ArrayType(T.FloatType()))])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                vecs = embed_batch(pdf[text_col].fillna("").tolist()) if len(pdf) else []
                yield pdf.assign(embedding=vecs)

        return df.mapInPandas(run, schema)

    return hook


def pandas_entities(detect: Callable[[str], list[tuple[str, str, float]]]) -> EntityHook:
    """A value detector from a function ``text -> (text, category,
    confidence) triples``, run with ``mapInPandas``; a call that raises gives
    null for its row."""

    def hook(df: DataFrame) -> DataFrame:
        kind = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("category", T.StringType()), T.StructField("confidence", T.DoubleType())]))
        schema = T.StructType(df.schema.fields + [T.StructField("entities", kind)])

        def one(text):
            try:
                return [{"text": t, "category": c, "confidence": float(p)} for t, c, p in detect(text or "")]
            except Exception:  # the detector's own failure: fall back to the name
                return None

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(entities=pd.Series([one(t) for t in pdf["text"]], index=pdf.index, dtype=object))

        return df.mapInPandas(run, schema)

    return hook


def pandas_reasoner(answer_batch: Callable[[pd.DataFrame], list[str]]) -> Reasoner:
    """A reasoner from a batch function ``findings frame -> answer texts``
    (``raw_1``), run with ``mapInPandas``."""

    def hook(df: DataFrame) -> DataFrame:
        schema = T.StructType(df.schema.fields + [T.StructField("raw_1", T.StringType())])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(raw_1=answer_batch(pdf) if len(pdf) else [])

        return df.mapInPandas(run, schema)

    return hook
