"""Cost-balanced packing of token pieces into sequences.

A document costs ``linear * n + quadratic * n**2`` (attention is confined to a
document).  A document longer than a sequence gives full sequences of its own
first; what is left of each document is packed: pieces in descending length,
each to the lowest-cost sequence that still has room for it.  The sequences of
a block have room for exactly the block's tokens: full ones, and one for each
binary digit of the rest, so a sequence's length is the full one or a power of
two and nothing is padded.  A piece that fits nowhere whole is cut to fill the
roomiest sequence; its rest goes back into the order.

A block is what a task has gathered when it reaches ``block_tokens``; blocks
are packed on their own, so no row is shuffled, memory is bounded by a block,
and a retried task gives the same rows again.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import ship_package, sized_slices, text_of

MAX_TOKENS = 4096
END_ID = 2
BLOCK_TOKENS = 1 << 20
#: Bytes of text encoded at once (one row at least).
TEXT_BYTES = 2 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 6144.0

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long, "
    "sequence_tokens long, ids array<int>"
)


def capacities(total: int, full: int) -> list[int]:
    """Sequence lengths that hold exactly ``total`` tokens: full ones, then
    falling powers of two."""
    rest = total % full
    return [full] * (total // full) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(lengths: list[int], full: int = MAX_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """``(piece, start, length, sequence, offset)`` of each part, and the
    sequences' lengths.  ``start`` is the place in the piece."""
    caps = capacities(sum(lengths), full)
    room, cost = np.array(caps, dtype=np.int64), np.zeros(len(caps))
    parts = []
    heap = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(heap)
    while heap:
        n, i, start = heapq.heappop(heap)
        n = -n
        fits = room >= n
        if fits.any():
            s, take = int(np.where(fits, cost, np.inf).argmin()), n
        else:
            s = int(room.argmax())
            take = int(room[s])
            heapq.heappush(heap, (take - n, i, start + take))
        parts.append((i, start, take, s, caps[s] - int(room[s])))
        room[s] -= take
        cost[s] += linear * take + quadratic * take * take
    return parts, caps


def _packed(path: str, full: int, end_id: int, block_tokens: int, linear: float, quadratic: float, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = bpe.word_table(path)
        first = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        rest: list[tuple] = []  # doc_id, start, ids, tokens of the document
        held = sequences = 0

        def add(doc_id, start, ids, tokens, sequence, offset, size):
            rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), tokens, first + sequence, offset, size, np.frombuffer(ids, "<i4") if with_ids else None))

        def flush():
            nonlocal held, sequences
            parts, caps = pack([len(r[2]) // 4 for r in rest], full, linear, quadratic)
            for i, start, n, s, offset in parts:
                doc_id, at, ids, tokens = rest[i]
                add(doc_id, at + start, ids[4 * start : 4 * (start + n)], tokens, sequences + s, offset, caps[s])
            sequences += len(caps)
            rest.clear()
            held = 0

        def out():
            cols = list(zip(*rows)) if rows else [[]] * 9
            rows.clear()
            kinds = [pa.int64()] * 8 + [pa.list_(pa.int32())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        for b in sized_slices(batches, 1, TEXT_BYTES):
            encoded, ends = words.encode(b.column(1), end_id)
            begin = 0
            for doc_id, upto in zip(b.column(0).to_pylist(), ends.tolist()):
                ids = encoded[begin:upto].tobytes()
                begin = upto
                tokens = len(ids) // 4
                cut = tokens - tokens % full
                for at in range(0, cut, full):
                    add(doc_id, at, ids[4 * at : 4 * (at + full)], tokens, sequences, 0, full)
                    sequences += 1
                if cut < tokens:
                    rest.append((doc_id, cut, ids[4 * cut :], tokens))
                    held += tokens - cut
                if held >= block_tokens:
                    flush()
            if len(rows) >= 4096:
                yield out()
        flush()
        yield out()

    return run


def pack_documents(
    docs: DataFrame,
    max_tokens: int = MAX_TOKENS,
    vocabulary: str | None = None,
    end_id: int = END_ID,
    block_tokens: int = BLOCK_TOKENS,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id``, ``start`` (the document's ids before it),
    ``length``, ``ids_crc32`` (of its ids as little-endian 32-bit numbers),
    ``doc_tokens`` (with the end id), ``sequence_id``, ``offset`` (there),
    ``sequence_tokens`` and, on demand, the ``ids``.

    A null or empty text is one token, the end id.  Null ids and repeated rows
    are packed like any other row; an empty table gives no rows.
    """
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    run = _packed(vocabulary or bpe.vocabulary_path(), max_tokens, end_id, block_tokens, linear, quadratic, with_ids)
    out = rows.mapInArrow(run, SCHEMA)
    return out if with_ids else out.drop("ids")
