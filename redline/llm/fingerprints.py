"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A paragraph (a line; a long one in pieces of ``PIECE_WORDS`` words) is hashed
with its number of earlier occurrences, so a text is a set of 64-bit digests.
A sketch has three tables of ``size`` cells; a digest goes to one cell of each:
the count goes up, the digest and a check of it are XORed in.  Subtracting the
sketches of two versions cancels what they share.  Peeling takes the digests
of pure cells (count 1 or -1, check right) out again and again until none is
left: the differing digests.  If cells stay over, both sketches are made anew
larger, with room for all digests of both.  The likeness of two texts is
``2 * shared / (digests of both)``; 1 for two texts without any.

The sketch of ``SIZE`` cells a table is the fingerprint, as hex.  It is a
function of the text, so equal texts have equal fingerprints.

Neighbours in the order of the ids meet as follows.  Percentiles of the ids
(actual ids) cut the table into ranges, one a task; the first row of a range
is also sent to the range that ends before it.  A task streams through its
range in order and keeps one row at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package, slices, text_of

PIECE_WORDS = 4
SIZE = 8
TABLES = 3
GROW = 4
ROOM = 0.45  # cells a table and digest at which peeling hardly fails (three tables need 1.23 cells a digest)
_BITS = (np.uint64(30), np.uint64(27), np.uint64(31))
_SHIFTS = np.array([[21 * k] for k in range(TABLES)], np.uint64)
_TABLE = np.arange(TABLES)[:, None]
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    """The check of digests: a 64-bit mix (splitmix64)."""
    x = x + _MIX[0]
    x ^= x >> _BITS[0]
    x *= _MIX[1]
    x ^= x >> _BITS[1]
    x *= _MIX[2]
    x ^= x >> _BITS[2]
    return x


def digests(text: str, piece_words: int = PIECE_WORDS) -> np.ndarray:
    """The distinct 64-bit digests of the paragraphs' pieces."""
    seen: dict[str, int] = {}
    out = []
    hashed = xxhash.xxh64_intdigest
    for line in text.split("\n"):
        words = line.split()
        for at in range(0, len(words), piece_words):
            piece = " ".join(words[at : at + piece_words])
            n = seen.get(piece, 0)
            seen[piece] = n + 1
            out.append(hashed(piece, n))
    return np.unique(np.array(out, np.uint64))


class Sketch:
    """Counts, XORed digests and XORed checks of ``TABLES * size`` cells."""

    __slots__ = ("counts", "keys", "checks", "size")

    def __init__(self, keys: np.ndarray, size: int = SIZE):
        n = TABLES * size
        self.size = size
        cells = _cells(keys, size)
        self.counts = np.bincount(cells, minlength=n).astype(np.int64)
        self.keys, self.checks = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        if len(keys):
            np.bitwise_xor.at(self.keys, cells, np.tile(keys, TABLES))
            np.bitwise_xor.at(self.checks, cells, np.tile(_mixed(keys), TABLES))

    def hex(self) -> str:
        return (self.counts.astype("<u4").tobytes() + self.keys.astype("<u8").tobytes() + self.checks.astype("<u8").tobytes()).hex()


def _cells(keys: np.ndarray, size: int) -> np.ndarray:
    """The digests' cells in each table, from other bits of the digest each
    (``size`` is a power of two)."""
    return (((keys >> _SHIFTS) & np.uint64(size - 1)).view(np.int64) + _TABLE * size).ravel()


def peel(a: Sketch, b: Sketch) -> tuple[np.ndarray, np.ndarray] | None:
    """The digests only in ``a`` and only in ``b``, or None on failure."""
    counts, keys, checks = a.counts - b.counts, a.keys ^ b.keys, a.checks ^ b.checks
    found: list[list[np.ndarray]] = [[], []]
    taken = 0
    while True:
        pure = np.nonzero((counts == 1) | (counts == -1))[0]
        k = keys[pure]
        check = checks[pure]
        good = np.nonzero(_mixed(k) == check)[0]
        if not len(good):
            break
        k, first = np.unique(k[good], return_index=True)
        good = good[first]
        sign = counts[pure[good]]
        found[0].append(k[sign == 1])
        found[1].append(k[sign == -1])
        cells = _cells(k, a.size)
        np.subtract.at(counts, cells, np.tile(sign, TABLES))
        np.bitwise_xor.at(keys, cells, np.tile(k, TABLES))
        np.bitwise_xor.at(checks, cells, np.tile(check[good], TABLES))
        taken += len(k)
        if taken > TABLES * a.size:
            return None
    if counts.any() or keys.any() or checks.any():
        return None
    return tuple(np.concatenate(x) if x else np.empty(0, np.uint64) for x in found)


def difference(a: np.ndarray, b: np.ndarray, sketch_a: Sketch | None = None, sketch_b: Sketch | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """The digests only in ``a``, only in ``b``, and the size that peeled.
    Sizes that cannot hold even the difference of the counts are passed over."""
    size = SIZE if sketch_a is None else sketch_a.size
    least = abs(len(a) - len(b))
    while TABLES * size < least:
        size *= GROW
    while True:
        usable = sketch_a is not None and sketch_b is not None and sketch_a.size == size
        x, y = (sketch_a, sketch_b) if usable else (Sketch(a, size), Sketch(b, size))
        # a table's cells differ in no more digests than there are; more than all cells cannot be peeled
        got = None if np.abs(x.counts[:size] - y.counts[:size]).sum() > TABLES * size else peel(x, y)
        if got is not None:
            return *got, size
        size *= GROW
        while size < ROOM * (len(a) + len(b)):  # next, room for all digests
            size *= GROW // 2


def likeness(a: np.ndarray, b: np.ndarray, sketch_a: Sketch | None = None, sketch_b: Sketch | None = None) -> float:
    total = len(a) + len(b)
    if not total:
        return 1.0
    only_a, only_b, _ = difference(a, b, sketch_a, sketch_b)
    return (total - len(only_a) - len(only_b)) / total


def edited(text: str, following: str) -> str:
    """``text`` with its last third replaced by the start of ``following``."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by range, in descending order of id; after a range's own rows
    come its guests: the first of them is the row that follows the last one."""
    held = None  # range, id, text, digests, sketch
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    for b in slices(batches):
        rows = []
        for span, guest, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("range", "guest", "doc_id", "text"))):
            if guest and (held is None or held[0] != span):
                continue
            keys = digests(text)
            sketch = Sketch(keys)
            if held is not None and held[0] == span:
                _, old_id, old, old_keys, old_sketch = held
                new = edited(old, text)
                new_keys = digests(new)
                new_sketch = Sketch(new_keys)
                rows.append((
                    old_id, len(old), hashlib.sha256(new.encode()).hexdigest(), old_sketch.hex(), new_sketch.hex(),
                    likeness(old_keys, new_keys, old_sketch, new_sketch), likeness(old_keys, keys, old_sketch, sketch),
                ))
            held = None if guest else (span, doc_id, text, keys, sketch)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def fingerprint_versions(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Every document's fingerprint and that of its edited text (its last
    ``n_chars // 3`` code points replaced by as many of the next document's
    first ones, or all of them).

    The next document is the one with the next smaller id; a null id counts as
    the smallest, equal ids go by a digest of the text, and after the last
    comes the first.  A single document follows itself.  Null texts count as
    empty; repeated rows give a row each; an empty table gives none.
    ``ranges``: how many tasks (default: the session's shuffle partitions).
    """
    spark = docs.sparkSession
    ship_package(spark)
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_ = F.col("doc_id").cast("long")
    rows = docs.select(id_.alias("doc_id"), F.coalesce(id_, F.lit(-(1 << 63))).alias("at"), text_of().alias("text"))
    shares = [i / ranges for i in range(1, ranges + 1)]
    found = rows.select(F.percentile_approx("at", F.lit(shares), F.lit(100 * ranges)).alias("at"), F.max("at").alias("top")).first()
    # range i holds (bounds[i - 1], bounds[i]] and begins with bounds[i]; at most one a task
    bounds = np.unique(np.array([*(found["at"] or []), *([found["top"]] if found["top"] is not None else [])], np.int64))

    @F.pandas_udf("array<struct<range: int, guest: boolean>>")
    def places(at: pd.Series) -> pd.Series:
        at = at.to_numpy(np.int64)
        span = np.searchsorted(bounds, at, "left")
        first = bounds[span] == at
        return pd.Series([
            [{"range": i, "guest": False}] + ([{"range": (i + 1) % len(bounds), "guest": True}] if f else [])
            for i, f in zip(span.tolist(), first.tolist())
        ])

    dealt = rows.withColumn("place", F.explode(places("at"))).select("place.*", "doc_id", "at", "text")
    ordered = dealt.repartition(max(ranges, len(bounds)), "range").sortWithinPartitions("range", "guest", F.col("at").desc(), F.xxhash64("text"))
    return ordered.select("range", "guest", "doc_id", "text").mapInArrow(_compared, SCHEMA)
