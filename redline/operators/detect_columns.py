"""Column (tabular) detection.

The first k non-blank values of every column (in row order) are sampled,
and each column is classified by its name and by the values of its samples.

* Tables (``scan_table``): one pass takes the first k rows by key
  (``TakeOrderedAndProject``: every task keeps a k-row heap, no sort); only a
  column with a blank among them gets a pass of its own —
  ``where(non-blank).orderBy(key).limit(k)``, where Parquet reads just the key
  and that column.
* Parsed files (``scan_columns`` over long-form ``cells``): a window
  ``row_number() <= k`` that Catalyst plans with a partial
  ``WindowGroupLimit`` before the exchange.

Whole columns are never grouped on one task: only the k samples are.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import rules as R
from ..hooks import EntityHook
from ..functions.columns import (
    classify_column_name,
    confident_counts,
    dominant_category,
    entity_category_counts,
    map_entity_category,
)
from ..functions.text import has_non_blank
from ..schemas import detection_finding


def table_cells(
    df: DataFrame,
    dataset: str,
    order_by: str | list[str],
    columns: Iterable[str] | None = None,
) -> DataFrame:
    """Unpivot a table to string cells; ``row_key`` orders the rows.

    Every cell becomes a string (the scanner's data model): NULL stays NULL.
    """
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    cols = list(columns) if columns is not None else list(df.columns)
    row_key = F.col(keys[0]) if len(keys) == 1 else F.struct(*[F.col(k) for k in keys])
    entries = F.array(
        *[
            F.struct(
                F.lit(i).cast("int").alias("col_pos"),
                F.lit(c).alias("column_name"),
                F.col(f"`{c}`").cast("string").alias("value"),
            )
            for i, c in enumerate(cols)
        ]
    )
    return df.select(
        F.lit(dataset).alias("dataset"), row_key.alias("row_key"), F.explode(entries).alias("c")
    ).select("dataset", "row_key", "c.col_pos", "c.column_name", "c.value")


def _present(c: Column, dtype: T.DataType) -> Column:
    """Non-blank test: non-text columns only need a value; text needs a
    non-white-space character (first character checked first)."""
    if not isinstance(dtype, T.StringType):
        return c.isNotNull()
    return has_non_blank(c)


def sample_table_values(
    df: DataFrame,
    dataset: str,
    order_by: str | list[str],
    k: int = R.SAMPLE_VALUES_PER_COLUMN,
    columns: Iterable[str] | None = None,
) -> DataFrame:
    """First ``k`` non-blank values of every column of a table in ``order_by``
    order (a unique key): ``(dataset, col_pos, column_name, sample_ord,
    value)``, one top-k per column."""
    tops, cols, n_keys = _column_tops(df, order_by, k, columns)
    names = F.array(*[F.lit(c) for c in cols])
    w = Window.partitionBy("col_pos").orderBy(*[F.col(f"_k{j}").asc() for j in range(n_keys)])
    return tops.select(
        F.lit(dataset).alias("dataset"),
        "col_pos",
        F.element_at(names, F.col("col_pos") + 1).alias("column_name"),
        F.row_number().over(w).cast("int").alias("sample_ord"),
        "value",
    )


def table_column_samples(
    df: DataFrame,
    dataset: str,
    order_by: str | list[str],
    k: int = R.SAMPLE_VALUES_PER_COLUMN,
    columns: Iterable[str] | None = None,
) -> DataFrame:
    """``(dataset, col_pos, column_name, samples)``: the ordered first ``k``
    non-blank values of every column, gathered straight from the per-column
    top-k (at most k values per group)."""
    tops, cols, n_keys = _column_tops(df, order_by, k, columns)
    names = F.array(*[F.lit(c) for c in cols])
    keyed = F.struct(*[F.col(f"_k{j}") for j in range(n_keys)], F.col("value"))
    return tops.groupBy("col_pos").agg(F.sort_array(F.collect_list(keyed)).alias("s")).select(
        F.lit(dataset).alias("dataset"),
        "col_pos",
        F.element_at(names, F.col("col_pos") + 1).alias("column_name"),
        F.transform("s", lambda x: x["value"]).alias("samples"),
    )


def _column_tops(df: DataFrame, order_by: str | list[str], k: int, columns: Iterable[str] | None):
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    cols = list(columns) if columns is not None else list(df.columns)
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    # one pass takes the first k rows; a column without a blank among them is done
    order = [F.col(f"_k{j}").asc() for j in range(len(keys))]
    head = df.select(
        *[F.col(f"`{kc}`").alias(f"_k{j}") for j, kc in enumerate(keys)],
        F.array(*[_present(F.col(f"`{c}`"), types[c]) for c in cols]).alias("_there"),
        F.array(*[F.col(f"`{c}`").cast("string") for c in cols]).alias("_v"),
    ).orderBy(*order).limit(k)
    there = head.select("_there").collect()  # k rows
    done = [all(r[0][i] for r in there) for i in range(len(cols))]
    first = head.select(*[f"_k{j}" for j in range(len(keys))], F.posexplode("_v").alias("col_pos", "value"))
    parts = [first.where(F.col("col_pos").isin([i for i, d in enumerate(done) if d]))] if any(done) else []
    for i, c in enumerate(cols):
        if done[i]:
            continue
        col = F.col(f"`{c}`")
        parts.append(
            df.where(_present(col, types[c]))
            .select(
                *[F.col(f"`{kc}`").alias(f"_k{j}") for j, kc in enumerate(keys)],
                F.lit(i).cast("int").alias("col_pos"),
                col.cast("string").alias("value"),
            )
            .orderBy(*[F.col(f"_k{j}").asc() for j in range(len(keys))])
            .limit(k)
        )
    return reduce(lambda a, b: a.unionByName(b), parts), cols, len(keys)


def sample_column_values(cells: DataFrame, k: int = R.SAMPLE_VALUES_PER_COLUMN) -> DataFrame:
    """First ``k`` non-blank values of every column in row order:
    ``(dataset, col_pos, column_name, sample_ord, value)``, and ``scan_id``
    where the cells have it (equal file names of two scans stay apart)."""
    keys = _dataset_keys(cells)
    w = Window.partitionBy(*keys, "col_pos").orderBy(F.col("row_key").asc())
    return (
        cells.where(has_non_blank(F.col("value")))
        .withColumn("sample_ord", F.row_number().over(w))
        .where(F.col("sample_ord") <= k)
        .select(*keys, "col_pos", "column_name", F.col("sample_ord").cast("int"), "value")
    )


def _dataset_keys(df: DataFrame) -> list[str]:
    return (["scan_id"] if "scan_id" in df.columns else []) + ["dataset"]


def column_samples(samples: DataFrame) -> DataFrame:
    """One row per column with its ordered samples (at most k per group)."""
    keys = _dataset_keys(samples)
    return samples.groupBy(*keys, "col_pos", "column_name").agg(
        F.sort_array(F.collect_list(F.struct("sample_ord", "value"))).alias("samples")
    ).select(
        *keys,
        "col_pos",
        "column_name",
        F.transform("samples", lambda s: s["value"]).alias("samples"),
    )


def classify_columns(
    per_column: DataFrame,
    entity_counts: Callable[[Column], Column] = entity_category_counts,
    entities: EntityHook | None = None,
) -> DataFrame:
    """Add ``name_type``, ``value_type`` and the chosen type per column.

    Values are judged on the samples joined by LF (so a pattern may run
    across two samples, as the reference detector does), by the pattern
    detector or by a plugged-in one: ``entities`` adds ``entities
    array<struct<category, confidence>>`` for ``text``; null (the detector
    failed) leaves the type to the column's name.
    """
    blob = F.array_join(F.col("samples"), "\n")
    if entities is not None:
        per_column = entities(per_column.withColumn("text", blob)).drop("text")
        counts = confident_counts(F.col("entities"))
    else:
        counts = entity_counts(blob)
    return per_column.select(
        "*",
        classify_column_name(F.col("column_name")).alias("name_type"),
        map_entity_category(dominant_category(counts)).alias("value_type"),
    )


def scan_samples(
    samples: DataFrame,
    scan_id: Column | str = "scan",
    entity_counts: Callable[[Column], Column] = entity_category_counts,
    created_at: Column | None = None,
    entities: EntityHook | None = None,
) -> DataFrame:
    """At most one finding per column; the value-confirmed type beats the
    name type (``AZURE`` vs ``KEYWORD``).  Columns with no non-blank value
    or a blank name give nothing.  ``samples`` is either one row per sample
    (``sample_ord, value``) or one row per column (``samples`` array)."""
    if "scan_id" in samples.columns:
        scan_col = F.col("scan_id")
    else:
        scan_col = F.lit(scan_id) if isinstance(scan_id, str) else scan_id
    per_column = samples if "samples" in samples.columns else column_samples(samples)
    per_col = classify_columns(per_column, entity_counts, entities)
    per_col = per_col.where(has_non_blank(F.col("column_name")))
    per_col = per_col.where(F.col("name_type").isNotNull() | F.col("value_type").isNotNull())
    return per_col.select(
        *detection_finding(
            scan_id=scan_col,
            data_type=F.coalesce(F.col("value_type"), F.col("name_type")),
            location=F.concat(F.col("dataset"), F.lit(":column="), F.col("column_name")),
            file_name=F.col("dataset"),
            line_no=F.lit(None),
            column_name=F.col("column_name"),
            rule_ord=F.lit(None),
            # the column's position: keeps ids apart when a header repeats a name
            match_ord=F.col("col_pos") + 1,
            snippet=F.substring(F.col("samples")[0], 1, R.COLUMN_SNIPPET_MAX),
            detected_by=F.when(F.col("value_type").isNotNull(), F.lit(R.DETECTED_BY_VALUES)).otherwise(
                F.lit(R.DETECTED_BY_NAME)
            ),
            created_at=created_at,
        )
    )


def scan_columns(
    cells: DataFrame,
    scan_id: Column | str = "scan",
    k: int = R.SAMPLE_VALUES_PER_COLUMN,
    entity_counts: Callable[[Column], Column] = entity_category_counts,
    created_at: Column | None = None,
    entities: EntityHook | None = None,
) -> DataFrame:
    """Column findings of long-form cells (parsed CSV/JSON files); cells that
    carry a ``scan_id`` keep it."""
    return scan_samples(sample_column_values(cells, k), scan_id, entity_counts, created_at, entities)


def scan_table(
    df: DataFrame,
    dataset: str,
    order_by: str | list[str],
    scan_id: Column | str = "scan",
    k: int = R.SAMPLE_VALUES_PER_COLUMN,
    entities: EntityHook | None = None,
) -> DataFrame:
    """Column findings of one table (``order_by``: a unique row key)."""
    return scan_samples(table_column_samples(df, dataset, order_by, k), scan_id=scan_id, entities=entities)

