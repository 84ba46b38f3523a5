"""Column functions for tabular detection: name rules and value entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as R


def normalize_name(name: Column) -> Column:
    """Lower-case and keep only letters and decimal digits."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{Nd}]", "")


def classify_column_name(name: Column) -> Column:
    """Data type suggested by a column name (substring rules, first wins)."""
    n = normalize_name(name)
    expr = None
    for needles, dtype in R.COLUMN_NAME_RULES:
        cond = None
        for k in needles:
            c = F.instr(n, k) > 0
            cond = c if cond is None else (cond | c)
        expr = F.when(cond, F.lit(dtype)) if expr is None else expr.when(cond, F.lit(dtype))
    return expr.otherwise(F.lit(None).cast("string"))


def map_entity_category(category: Column) -> Column:
    """Entity category -> data type (fixed map, otherwise upper-cased)."""
    m = F.create_map(*[F.lit(x) for kv in R.ENTITY_CATEGORY_MAP.items() for x in kv])
    return F.coalesce(m[category], F.upper(category))


def detect_entities(text: Column) -> Column:
    """Offline value detector: ``array<struct<text, category, confidence>>``
    of every match of the four patterns, in pattern order.  Blank -> []."""
    parts = []
    for _, cat, pat in R.ENTITY_PATTERNS:
        parts.append(
            F.transform(
                F.regexp_extract_all(text, F.lit(pat), 0),
                _entity(cat),
            )
        )
    from .text import has_non_blank

    empty = F.array().cast("array<struct<text:string,category:string,confidence:double>>")
    return F.when(has_non_blank(text), F.flatten(F.array(*parts))).otherwise(empty)


def _entity(cat: str):
    def mk(m: Column) -> Column:
        return F.struct(
            m.alias("text"),
            F.lit(cat).alias("category"),
            F.lit(R.ENTITY_CONFIDENCE).cast("double").alias("confidence"),
        )

    return mk


def filter_confidence(entities: Column, min_confidence: float = R.MIN_ENTITY_CONFIDENCE) -> Column:
    """Keep entities at or above ``min_confidence``; null text -> '' and
    null category -> 'Unknown' (shape of a remote detector's answer)."""
    kept = F.filter(entities, lambda e: e["confidence"] >= F.lit(min_confidence))
    return F.transform(
        kept,
        lambda e: F.struct(
            F.coalesce(e["text"], F.lit("")).alias("text"),
            F.coalesce(e["category"], F.lit("Unknown")).alias("category"),
            e["confidence"].alias("confidence"),
        ),
    )


def entity_category_counts(text: Column) -> Column:
    """``array<struct<cnt int, neg_ord int, category string>>`` of the
    categories with at least one hit (offline detector)."""
    counts = []
    for ordn, cat, pat in R.ENTITY_PATTERNS:
        counts.append(
            F.struct(
                F.size(F.regexp_extract_all(text, F.lit(pat), 0)).alias("cnt"),
                F.lit(-ordn).alias("neg_ord"),
                F.lit(cat).alias("category"),
            )
        )
    return F.filter(F.array(*counts), lambda s: s["cnt"] > 0)


def confident_counts(entities: Column) -> Column:
    """``entity_category_counts`` of a plugged-in detector's entities: those of
    enough confidence, categories in first-seen order; null stays null."""
    kept = filter_confidence(entities)
    seen = F.array_distinct(F.transform(kept, lambda e: e["category"]))
    return F.transform(
        seen,
        lambda c, i: F.struct(F.size(F.filter(kept, lambda e: e["category"] == c)).alias("cnt"), (-i).alias("neg_ord"), c.alias("category")),
    )


def dominant_category(counts: Column) -> Column:
    """Most frequent category; ties go to the first seen (pattern order)."""
    return F.when(F.size(counts) > 0, F.array_max(counts)["category"])


def is_dataset(file_name: Column, language: Column) -> Column:
    fn = F.lower(file_name)
    lang = F.lower(F.coalesce(language, F.lit("")))
    return fn.endswith(".csv") | fn.endswith(".json") | (lang == "csv") | (lang == "json")


def is_json_dataset(file_name: Column, language: Column) -> Column:
    return F.lower(file_name).endswith(".json") | (F.lower(F.coalesce(language, F.lit(""))) == "json")
