"""Chat formatting by columnar byte assembly.

Turns are formatted batch by batch: a turn is a header, its escaped text and a
footer.  The lengths of all segments give, by cumulative sums, the place of
each one in one output buffer; numpy copies headers, texts and footers there
through scatter indices, and the buffer becomes an Arrow string column without
a Python string per turn.

Template::

    <<SYS>>\\n text \\n<</SYS>>     system
    [INST] text [/INST]           user
    <s> text </s>                 assistant; its text is under the loss mask
    <s>:role\\n text </s>          any other role

Control strings inside a text or role get a backslash after their first
character, and one more where they already have some (``</s>``, ``<\\/s>``,
``<\\\\/s>`` ...), so a formatted text holds a control string only where the
template put it and ``unescape`` gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package, text_of

HEAD = {"system": "<<SYS>>\n", "user": "[INST] ", "assistant": "<s> "}
FOOT = {"system": "\n<</SYS>>", "user": " [/INST]", "assistant": " </s>"}
OTHER_HEAD, OTHER_FOOT = "<s>:", " </s>"
CONTROL = r"(<)(\\*(?:/?s>|</?SYS>>))|(\[)(\\*/?INST\])"
_ESCAPED = re.compile(r"(<)\\(\\*(?:/?s>|</?SYS>>))|(\[)\\(\\*/?INST\])")
#: Longer segments are copied one by one instead of through the index.
COPY_BYTES = 1 << 16
BATCH_ROWS = 1024


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, CONTROL, r"\1\3\\\2\4")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: (m[1] or m[3]) + (m[2] if m[1] else m[4]), text) if "\\" in text else text


def _bytes_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets (from 0) of a string array without nulls."""
    strings = strings.cast(pa.large_string()) if strings.offset == 0 else pa.array(strings.to_pylist(), pa.large_string())
    _, offsets, data = strings.buffers()
    offsets = np.frombuffer(offsets, np.int64)[: len(strings) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), offsets


def assemble(pieces: list[pa.Array]) -> pa.Array:
    """Row by row the concatenation of the arrays' strings, built in one
    preallocated buffer."""
    n, k = len(pieces[0]), len(pieces)
    sources = [_bytes_of(p) for p in pieces]
    lengths = np.stack([np.diff(o) for _, o in sources], axis=1).ravel()  # by row, then by piece
    ends = np.cumsum(lengths)
    at = ends - lengths
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for j, (data, offsets) in enumerate(sources):
        size, to, start = lengths[j::k], at[j::k], offsets[:-1]
        small = size <= COPY_BYTES
        for i in np.nonzero(~small)[0]:
            out[to[i] : to[i] + size[i]] = data[start[i] : start[i] + size[i]]
        size, to, start = size[small], to[small], start[small]
        ramp = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[np.repeat(to, size) + ramp] = data[np.repeat(start, size) + ramp]
    offsets = np.concatenate([[0], ends[k - 1 :: k]]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def format_turns(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The formatted turns, and for each the place and length (code points)
    of its text in it and whether it is under the loss mask."""
    coded = pc.fill_null(roles, "").dictionary_encode()
    names = coded.dictionary.to_pylist()
    named = [pc.replace_substring(pc.replace_substring(pa.array([r]), "\\", "\\\\"), "\n", "\\n") for r in names]
    heads = [HEAD.get(r) or f"{OTHER_HEAD}{escape(x)[0].as_py()}\n" for r, x in zip(names, named)]
    feet = [FOOT.get(r, OTHER_FOOT) for r in names]
    head = pa.array(heads, pa.large_string()).take(coded.indices)
    foot = pa.array(feet, pa.large_string()).take(coded.indices)
    body = escape(pc.fill_null(texts, ""))
    count = lambda x: pc.utf8_length(x).to_numpy(zero_copy_only=False).astype(np.int64)
    learned = np.array([r == "assistant" for r in names], bool)[coded.indices.to_numpy()] if names else np.empty(0, bool)
    return assemble([head, body, foot]), count(head), count(body), learned


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted text."""
    out, at = [], 0
    while at < len(text):
        for role, head in HEAD.items():
            if text.startswith(head, at):
                foot, at = FOOT[role], at + len(head)
                break
        else:
            if not text.startswith(OTHER_HEAD, at):
                raise ValueError(f"no turn begins at {at}")
            end = text.index("\n", at)
            role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text[at + len(OTHER_HEAD) : end]))
            foot, at = OTHER_FOOT, end + 1
        end = text.index(foot, at)  # no escaped text holds it
        out.append((role, unescape(text[at:end])))
        at = end + len(foot)
    return out


FORMATTED = "conv_id long, part long, formatted string, n_turns long, loss array<struct<start: long, length: long>>"


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of conversations: the turns of one conversation in one batch."""
    last, part = None, 0
    for b in batches:
        for at in range(0, b.num_rows, BATCH_ROWS):
            s = b.slice(at, BATCH_ROWS)
            turns, head, body, learned = format_turns(s.column("role"), s.column("text"))
            size = pc.utf8_length(turns).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = s.column("conv_id").to_pylist()
            starts = [i for i in range(len(ids)) if i == 0 or ids[i] != ids[i - 1]]
            _, offsets, data = turns.buffers()
            byte_ends = np.frombuffer(offsets, np.int64)
            ends = [*starts[1:], len(ids)]
            # the turns of a conversation lie one after the other in the buffer
            whole = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(byte_ends[[*starts, len(ids)]].copy()), data])
            rows = []
            for i, j in zip(starts, ends):
                part = part + 1 if last == (ids[i],) else 0
                last = (ids[i],)
                to = np.cumsum(size[i:j]) - size[i:j] + head[i:j]
                rows.append((ids[i], part, j - i, [{"start": int(a), "length": int(n)} for a, n, y in zip(to, body[i:j], learned[i:j]) if y]))
            conv, parts, n, loss = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(conv, pa.int64()), pa.array(parts, pa.int64()), whole.cast(pa.string()), pa.array(n, pa.int64()),
                 pa.array(loss, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))],
                ["conv_id", "part", "formatted", "n_turns", "loss"],
            )


def format_conversations(turns: DataFrame) -> DataFrame:
    """The formatted conversations: ``conv_id, part, formatted, n_turns, loss``.

    Turns go in order of ``turn`` (then role and text, so ties and repeated
    rows have one order; a null turn comes first).  ``loss`` holds the places
    of the assistants' texts in ``formatted``, in code points.  A conversation
    is one part, or several (in order, to be joined as they are) when its turns
    reach over a batch: a task never gathers a whole conversation, however long.
    Null roles and texts count as empty, null ids are one conversation.  The
    parts of a conversation stand together and in order in one partition.
    """
    ship_package(turns.sparkSession)
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text")
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_formatted, FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now: list | None = None

    def closed():
        return (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])

    def batch(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = [c.split()[0] for c in DIGEST.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for b in batches:
        rows = []
        for conv, part, text, loss in zip(*(b.column(c).to_pylist() for c in ("conv_id", "part", "formatted", "loss"))):
            if now is None or part == 0:
                if now is not None:
                    rows.append(closed())
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in parse(text):
                now[1] += 1
                now[2].update(f"{role}\n{said}\n".encode())
            for x in loss:
                said = unescape(text[x["start"] : x["start"] + x["length"]])
                now[3] += len(said)
                now[4].update(said.encode())
            now[5] += len(text)
        if rows:
            yield batch(rows)
    if now is not None:
        yield batch([closed()])


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation of ``format_conversations``' result, from its formatted
    texts and loss places alone: the number of turns, digests of turns and of
    the text under the loss mask, and the formatted length."""
    ship_package(formatted.sparkSession)
    return formatted.mapInArrow(_read_back, DIGEST)
