"""Main text of HTML pages: nearest-URL page differencing under the markup.

Pages of one template repeat their menus, notices and link lists line for
line; their articles differ.  The pages of a host are ordered by URL path and
each is paired with its nearest neighbour there; the two pages' text lines are
aligned by a longest common subsequence, and the shared lines are deleted.

Differencing alone is not right: a menu, advert or footer that differs from
page to page is not shared, and articles that quote or copy one another are.
So the markup (``html_blocks``) comes first: it leaves out what its elements
and names call no article, and keeps what stands in an article; differencing
decides the lines that it leaves open (all lines of a page without article
markup, and blocks of mere links in an article).

First pass: each page's lines become hashes.  Equal pages of a host are one
candidate.  Candidates with an open line somewhere near are ordered by (host,
path) and numbered over all partitions, so a host of any size is spread over
many tasks; blocks of ``BLOCK`` neighbours, with ``NEAR`` guests on either
side, are aligned.  Second pass: the pages are parsed again; only pages with
open lines are joined to what the alignment deletes.  No text is shuffled but
theirs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_table, ship_package, slices
from .html_blocks import OPEN, blocks
from .merkle import numbered

#: Neighbours in URL order that are looked at on either side.
NEAR = 2
BLOCK = 512
#: Two pages whose shared lines hold this share of both texts are copies of each other.
COPY = 0.8
#: Parts of a hot page's join.
SALT = 16

PAGE = "page_id long, url string, host string, digest long, open boolean, lines array<string>, flags binary"


def address(url: str | None) -> tuple[str | None, str]:
    """Host (null if none) and path with query of a URL."""
    try:
        parts = urlsplit(url or "")
        host = parts.hostname
    except ValueError:
        return None, url or ""
    return host or None, parts.path + (f"?{parts.query}" if parts.query else "")


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Indices of ``a`` in a longest common subsequence with ``b`` (bit-parallel:
    a row of the table is one integer; only every ``isqrt(len(a))``-th row and
    the rows of one stretch are held)."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    places: dict[int, int] = {}
    for j, v in enumerate(y):
        places[v] = places.get(v, 0) | 1 << j
    full = (1 << len(y)) - 1

    def following(row: int, v: int) -> int:
        u = row & places.get(v, 0)
        return ((row + u) | (row - u)) & full

    step = isqrt(len(x)) + 1
    marks, row = [full], full
    for i, v in enumerate(x):
        row = following(row, v)
        if (i + 1) % step == 0:
            marks.append(row)
    found: list[int] = []
    col = len(y)
    for k in range(len(marks) - 1, -1, -1):
        rows = [marks[k]]
        for v in x[k * step : (k + 1) * step]:
            rows.append(following(rows[-1], v))
        i = len(rows) - 1
        while i and col:  # rows[i] is the table's row k * step + i
            if rows[i] >> (col - 1) & 1:
                col -= 1
            else:
                i -= 1
                if rows[i] >> (col - 1) & 1:
                    col -= 1
                    found.append(k * step + i)
    return [*range(head), *(head + i for i in reversed(found)), *range(len(a) - tail, len(a))]


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        rows = []
        for page_id, url, page in zip(*(b.column(i).to_pylist() for i in range(3))):
            found = blocks(page)
            flags = bytes(f for _, f in found)
            lines = [x for x, _ in found]
            digest = xxhash.xxh64(flags)
            for x in lines:
                digest.update(f"{len(x)}:{x}".encode("utf-8", "surrogatepass"))
            rows.append((page_id, url, address(url)[0], digest.intdigest() - (1 << 63), OPEN in flags, lines, flags))
        names = [c.split()[0] for c in PAGE.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.string()), pa.binary()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


CANDIDATE = "host string, digest long, path string, hashes array<long>, sizes array<int>, flags binary"


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in CANDIDATE.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
    for b in _parsed(batches):
        rows = []
        for url, host, digest, lines, flags in zip(*(b.column(c).to_pylist() for c in ("url", "host", "digest", "lines", "flags"))):
            if host is not None and lines:  # a page without a host has no neighbours
                hashes = [xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x in lines]
                rows.append((host, digest, address(url)[1], hashes, [len(x) for x in lines], flags))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def nearest_shared(pages: list[tuple[str, str, list[int], list[int], bytes]], at: int, near: int = NEAR, copy: float = COPY) -> list[int]:
    """Of page ``at`` of ``pages`` (host, path, hashes, sizes, flags; in URL order):
    the indices of its open lines that its nearest page shares.  Nearest has
    the longest path beginning in common, then the least distance, then comes
    first; copies of the page are passed over."""
    host, path, hashes, sizes, flags = pages[at]
    around = []
    for other in range(max(0, at - near), min(len(pages), at + near + 1)):
        if other != at and pages[other][0] == host:
            same = 0
            for p, q in zip(path, pages[other][1]):
                if p != q:
                    break
                same += 1
            around.append((-same, abs(other - at), other))
    for _, _, other in sorted(around):
        shared = common_lines(hashes, pages[other][2])
        size = sum(sizes[i] for i in shared)
        if size < copy * sum(sizes) or size < copy * sum(pages[other][3]):
            return [i for i in shared if flags[i] == OPEN]
    return []


def _aligner(size: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("position")
        pages = list(zip(*(rows.column(c).to_pylist() for c in ("host", "path", "hashes", "sizes", "flags"))))
        digests, block = rows.column("digest").to_pylist(), key[0].as_py()
        out = []
        for i, position in enumerate(rows.column("position").to_pylist()):
            if position // size == block and OPEN in pages[i][4]:
                gone = nearest_shared(pages, i)
                if gone:
                    out.append((pages[i][0], digests[i], gone))
        cols = list(zip(*out)) if out else [[], [], []]
        return pa.table({"host_": pa.array(cols[0], pa.string()), "digest_": pa.array(cols[1], pa.int64()), "gone": pa.array(cols[2], pa.list_(pa.int32()))})

    return run


def shared_lines(pages: DataFrame, size: int = BLOCK) -> DataFrame:
    """(``host_``, ``digest_``, ``gone``): the lines that differencing deletes from
    the pages of a host with that digest."""
    found = pages.mapInArrow(_candidates, CANDIDATE)
    # equal pages of a host are one candidate, at the first of their paths
    one = found.groupBy("host", "digest").agg(
        F.min("path").alias("path"), *[F.first(c).alias(c) for c in ("hashes", "sizes", "flags")]
    )
    placed = numbered(shared_table(one, "html-candidates"), "html-order", ["host"], ["path", "digest"], [])
    placed = placed.withColumn("position", F.col("first") + F.col("rank"))
    here, at = F.floor(F.col("position") / size), F.col("position") % size
    to = F.array_compact(F.array(here, F.when((at < NEAR) & (here > 0), here - 1), F.when(at >= size - NEAR, here + 1)))
    dealt = placed.select("position", "host", "path", "digest", "hashes", "sizes", "flags", F.explode(to).alias("block"))
    return dealt.groupBy("block").applyInArrow(_aligner(size), "host_ string, digest_ long, gone array<int>")


def extract_main_text(pages: DataFrame, size: int = BLOCK) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` (code points) of every page.

    A null or empty page has an empty text.  Null ids and URLs and repeated
    rows are kept; a page without a host is not paired; an empty table gives no
    rows; other columns than ``page_id``, ``url`` and ``html`` are not read.
    ``size``: neighbours aligned by one group; the result does not depend on it.
    """
    ship_package(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    gone = shared_table(shared_lines(rows, size), "html-gone")
    parsed = rows.mapInArrow(_parsed, PAGE)
    closed = parsed.where("NOT open OR host IS NULL").select("page_id", "url", "lines")
    # a page with thousands of copies is one key: its rows are dealt in parts
    salted = parsed.where("open AND host IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)))
    spread = gone.withColumn("salt_", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    on = (F.col("host") == F.col("host_")) & (F.col("digest") == F.col("digest_")) & (F.col("salt") == F.col("salt_"))
    kept = F.filter("lines", lambda x, i: ~F.coalesce(F.array_contains("gone", i), F.lit(False)))
    differed = salted.join(spread, on, "left").select("page_id", "url", kept.alias("lines"))
    text = F.array_join("lines", "\n")
    return closed.unionByName(differed).select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))
