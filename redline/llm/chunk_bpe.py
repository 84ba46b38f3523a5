"""BPE encoding and decoding with content-defined chunk reuse.

Each text is cut where a rolling hash over its last 16 bytes hits a mask, so
passages that documents share give the same chunks wherever they stand.  A
chunk's inner part (from its first to its last white space) is encoded once
and looked up afterwards.  A cut may fall inside a run of characters that the
tokenizer handles as a whole; such a join is repaired by encoding the run
again from both sides of the cut, widened chunk by chunk until it begins and
ends at white space.  There the new ids agree with those of both neighbours,
because the tokenizer never merges across white space.

Chunks are shared inside a task and between the tasks of a worker, in a memo
of bounded size; a chunk that many documents share is encoded once a worker.
Sharing them between workers would mean to shuffle every chunk and its ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import ship_package, slices, text_of

WINDOW_BITS = 4  # the hash covers 2**4 bytes
CHUNK_BITS = 10  # a cut every 2**10 bytes on average
SEGMENT = 1 << 20  # bytes hashed at once
CHUNK_MEMO_BYTES = 48 << 20

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chunks long, n_reused long, ids array<int>, decoded string"

# One random 64-bit number a byte value, from a fixed seed.
_GEAR = np.random.default_rng(16).integers(0, 1 << 63, 256, dtype=np.uint64)


def cuts(data: bytes, bits: int = CHUNK_BITS) -> list[int]:
    """Ends of the chunks of ``data`` (UTF-8), none inside a character."""
    n, found = len(data), []
    window = 1 << WINDOW_BITS
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, n, SEGMENT):
        lo = max(0, at - window + 1)
        h = _GEAR[raw[lo : at + SEGMENT]]
        for b in range(WINDOW_BITS):
            w = 1 << b
            g = h.copy()
            g[w:] += h[:-w] << np.uint64(w)
            h = g
        hit = np.nonzero((h >> np.uint64(40)) & np.uint64((1 << bits) - 1) == 0)[0] + lo + 1
        found.append(hit[(hit > at) & (hit < n)])
    ends = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    while len(ends) and (inside := (raw[ends] & 0xC0) == 0x80).any():  # a cut moves to the next character's start
        ends = ends + inside
        ends = np.unique(ends[ends < n])
    return [*ends.tolist(), n] if n else []


def _places(text: str) -> tuple[int, int]:
    """First and last place of a space or line feed, or -1."""
    a = [p for p in (text.find(" "), text.find("\n")) if p >= 0]
    return (min(a), max(text.rfind(" "), text.rfind("\n"))) if a else (-1, -1)


class ChunkCodec:
    """Encodes whole texts to ``(ids as text, decoded text, count)`` parts."""

    def __init__(self, path: str, bits: int = CHUNK_BITS):
        tokens = bpe.tokenizer(path).id_to_token

        def make(ids):
            return (" ".join(map(str, ids)), " ".join(map(tokens, ids)), len(ids)) if ids else ("", "", 0)

        self.words, self.bits = bpe.memo(path, "texts", make), bits
        self.chunks: dict[bytes, tuple] = {}
        self.held = 0

    def encoded(self, text: str) -> tuple[str, str, int]:
        """The parts of a text that begins and ends at white space or an end."""
        got = [v for v in self.words.values(bpe.runs(text)) if v[2]]
        return " ".join(v[0] for v in got), " ".join(v[1] for v in got), sum(v[2] for v in got)

    def chunk(self, data: bytes) -> tuple[tuple, bool]:
        """(text before the first white space, encoded inner part, text after
        the last) of a chunk, or (text, None, None) without white space."""
        if (got := self.chunks.get(data)) is not None:
            return got, True
        text = data.decode()
        a, b = _places(text)
        got = (text, None, None) if a < 0 else (text[:a], self.encoded(text[a : b + 1]), text[b + 1 :])
        size = 2 * len(data) + (len(got[1][0]) + len(got[1][1]) if got[1] else 0) + 300
        if self.held + size > CHUNK_MEMO_BYTES:
            self.chunks, self.held = {}, 0
        if size <= CHUNK_MEMO_BYTES // 64:
            self.chunks[data] = got
            self.held += size
        return got, False

    def encode(self, text: str) -> tuple[list[tuple[str, str, int]], int, int]:
        """The encoded parts of a whole text in order, how many chunks it had
        and how many of them were not encoded anew."""
        data = text.encode()
        parts, joint, reused, at = [], [], 0, 0
        ends = cuts(data, self.bits)
        for end in ends:
            (head, inner, tail), known = self.chunk(data[at:end])
            reused += known
            at = end
            joint.append(head)
            if inner is None:  # no white space: the join widens to the next chunk
                continue
            parts += [self.encoded("".join(joint)), inner]
            joint = [tail]
        parts.append(self.encoded("".join(joint)))
        return [p for p in parts if p[2]], len(ends), reused


_codecs: dict[tuple, ChunkCodec] = {}


def _coded(path: str, bits: int, outputs: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codecs.setdefault((path, bits), ChunkCodec(path, bits))
        for b in slices(batches):
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                parts, n, reused = codec.encode(text)
                ids, decoded = hashlib.sha256(), hashlib.sha256()
                for k, p in enumerate(parts):
                    ids.update((" " * (k > 0) + p[0]).encode())
                    decoded.update((" " * (k > 0) + p[1]).encode())
                rows.append((
                    doc_id, sum(p[2] for p in parts), ids.hexdigest(), decoded.hexdigest(), n, reused,
                    [int(i) for p in parts for i in p[0].split(" ")] if outputs else None,
                    " ".join(p[1] for p in parts) if outputs else None,
                ))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.string()]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chunks", "n_reused", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return run


def encode_decode(docs: DataFrame, vocabulary: str | None = None, chunk_bits: int = CHUNK_BITS, outputs: bool = True) -> DataFrame:
    """Per row of ``docs``: the number of ids, the SHA-256 of the decimal ids
    joined by spaces and of the decoded text, the chunk counts and, with
    ``outputs``, the ids and the decoded text themselves.

    Ids equal the tokenizers library's for the whole text; the decoded text
    equals its ``decode`` with special tokens kept (this vocabulary has no
    decoder: tokens joined by spaces).  Null counts as empty: no ids, an empty
    decoded text.  Repeated rows and null ids give a row each.
    """
    ship_package(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    out = rows.mapInArrow(_coded(vocabulary or bpe.vocabulary_path(), chunk_bits, outputs), SCHEMA)
    return out if outputs else out.drop("ids", "decoded")
