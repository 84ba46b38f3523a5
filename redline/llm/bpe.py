"""Word-wise use of a public BPE tokenizer with a bounded memo.

The tokenizer drops white space before it merges, so a space or line feed
always ends a piece and the ids of a text are the ids of its runs between
them, one after the other.  A run that occurs again is looked up, not encoded.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Runs in each of the two halves of a worker's memo; beyond it the newer half
#: becomes the older one, which is dropped.
MEMO_WORDS = 400_000
#: Longer runs are encoded each time.
MEMO_CHARS = 48
#: Runs in a worker's table.
TABLE_WORDS = 400_000
VOCABULARY = "word_bpe_49k.json"

_tokenizers: dict[str, object] = {}
_memos: dict[tuple, object] = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(path: str):
    """The tokenizer of the file ``path``, without truncation and padding."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _tokenizers[path] = t
    return _tokenizers[path]


# A comma or full stop after a letter or digit is a piece of its own (letters
# and digits never share one with punctuation), so words meet with and without it.
_STOP = re.compile(r"(?<=[A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])(?=[.,](?: |\n|$))")


def runs(text: str) -> list[str]:
    """The runs between spaces and line feeds (empty ones too), commas and full
    stops at their ends apart."""
    return _STOP.sub(" ", text).replace("\n", " ").split(" ")


class WordMemo:
    """Maps runs to ``make(ids)``; ``make`` gets the list of ids."""

    def __init__(self, path: str, make: Callable[[list[int]], object], limit: int = MEMO_WORDS):
        self.tokenizer, self.make, self.limit = tokenizer(path), make, limit
        self.memo: dict[str, object] = {"": make([])}
        self.old: dict[str, object] = {}

    def values(self, words: list[str]) -> list:
        out = list(map(self.memo.get, words))
        if None not in out:
            return out
        miss = {w for w, v in zip(words, out) if v is None}
        made = {w: v for w in miss if (v := self.old.get(w)) is not None}
        new = [w for w in miss if w not in made]
        for at in range(0, len(new), 4096):
            part = new[at : at + 4096]
            made.update(zip(part, (self.make(e.ids) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False))))
        out = [made[w] if v is None else v for w, v in zip(words, out)]
        if len(self.memo) + len(made) > self.limit:  # the words in use move over from the old half
            self.old, self.memo = self.memo, {"": self.memo[""]}
        self.memo.update((w, v) for w, v in made.items() if len(w) <= MEMO_CHARS)
        return out

    def of_texts(self, texts: Iterable[str]) -> list[list]:
        """The values of each text's runs; the texts' misses are encoded together."""
        parts = [runs(t) for t in texts]
        flat = self.values([w for p in parts for w in p])
        out, at = [], 0
        for p in parts:
            out.append(flat[at : at + len(p)])
            at += len(p)
        return out


def memo(path: str, kind: str, make: Callable[[list[int]], object]) -> WordMemo:
    """The worker's memo of this kind; it outlives a task."""
    if (path, kind) not in _memos:
        _memos[path, kind] = WordMemo(path, make)
    return _memos[path, kind]


#: Steps of a tokenizer by which a run of ASCII letters is one piece in lower case.
_LOWERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLITS = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}


def takes_letters_whole(t) -> bool:
    """Whether the tokenizer's steps before its model are the known ones, and no
    added token is a run of letters."""
    steps = json.loads(t.to_str())
    return (
        steps["normalizer"] == {"type": "Sequence", "normalizers": _LOWERS}
        and steps["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_SPLITS, _BYTES]}
        and all(a["content"].startswith("<") for a in steps["added_tokens"])
    )


class WordTable:
    """The ids of runs in one buffer: texts are cut into runs, each distinct run
    of a batch is looked up once, and the ids are gathered by offsets.

    Runs are kept from batch to batch, up to ``limit``; beyond it the table
    begins anew.  Runs longer than ``MEMO_CHARS`` are kept for their batch only.
    Where the tokenizer lowers case and takes a run of letters as one piece, a
    run of ASCII letters goes to its model at once, in lower case.
    """

    def __init__(self, path: str, limit: int = TABLE_WORDS):
        self.tokenizer, self.limit = tokenizer(path), limit
        self.plain = takes_letters_whole(self.tokenizer)
        self.pool = np.empty(1 << 20, np.uint32)
        self.starts, self.lengths = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.words = self.used = 0

    def _add(self, ids: list[list[int]]) -> int:
        """Appends the ids of runs and returns the place of the first."""
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        upto = self.used + np.cumsum(lengths)
        end, words = int(upto[-1]) if len(ids) else self.used, self.words + len(ids)
        if end > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(max(end - len(self.pool), len(self.pool)), np.uint32)])
        if words > len(self.starts):
            more = np.zeros(max(words - len(self.starts), len(self.starts)), np.int64)
            self.starts, self.lengths = np.concatenate([self.starts, more]), np.concatenate([self.lengths, more])
        self.pool[self.used : end] = np.fromiter(chain.from_iterable(ids), np.uint32, end - self.used)
        self.starts[self.words : words], self.lengths[self.words : words] = upto - lengths, lengths
        first, self.used, self.words = self.words, end, words
        return first

    def _encoded(self, words: list[str]) -> dict[str, int]:
        """The places of new runs."""
        letters = [w for w in words if w.isalpha() and w.isascii()] if self.plain else []
        one = self.tokenizer.model.tokenize
        ids = [[t.id for t in one(w)] for w in letters]
        rest = [w for w in words if not (w.isalpha() and w.isascii())] if self.plain else words
        for at in range(0, len(rest), 4096):
            ids += [e.ids for e in self.tokenizer.encode_batch_fast(rest[at : at + 4096], add_special_tokens=False)]
        first = self._add(ids)
        return dict(zip(chain(letters, rest), range(first, first + len(ids))))

    def _places(self, words: list[str]) -> tuple[np.ndarray, int]:
        """The places of runs, and how many the table keeps; the long ones come last."""
        found = list(map(self.index.get, words))
        new = {w for w, v in zip(words, found) if v is None} if None in found else ()
        self.index.update(self._encoded([w for w in new if len(w) <= MEMO_CHARS]))
        kept = self.words
        long = self._encoded([w for w in new if len(w) > MEMO_CHARS])
        if new:
            found = [(self.index.get(w) if (p := long.get(w)) is None else p) if v is None else v for w, v in zip(words, found)]
        return np.array(found, np.int64), kept

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by ``end_id``, and where each ends."""
        if len(self.index) > self.limit:
            self.clear()
        # a comma or full stop after an ASCII letter or digit is a piece of its own
        apart = pc.replace_substring_regex(pc.replace_substring(texts, "\n", " "), "([A-Za-z0-9])([.,])( |$)", r"\1 \2\3")
        runs = pc.split_pattern(apart, " ")
        distinct = runs.flatten().dictionary_encode()
        words = distinct.dictionary
        if self.plain:  # the lower case of ASCII is the tokenizer's own; "<" may begin a special token, which has a case
            same = pc.or_(pc.invert(pc.string_is_ascii(words)), pc.match_substring(words, "<"))
            words = pc.if_else(same, words, pc.ascii_lower(words))
        places, kept = self._places(words.to_pylist())
        end = self._add([[end_id]])
        last = np.cumsum(pc.list_value_length(runs).to_numpy(zero_copy_only=False))
        at = np.insert(places[distinct.indices.to_numpy(zero_copy_only=False)], last, end)
        lengths = self.lengths[at]
        upto = np.cumsum(lengths)
        ids = self.pool[np.repeat(self.starts[at] - (upto - lengths), lengths) + np.arange(upto[-1] if len(upto) else 0)]
        ends = upto[last + np.arange(len(last))]
        # what is kept for this batch only goes
        self.words = kept
        self.used = int(self.starts[kept - 1] + self.lengths[kept - 1]) if kept else 0
        return ids, ends


def word_table(path: str) -> WordTable:
    """The worker's table; it outlives a task."""
    if (path, "table") not in _memos:
        _memos[path, "table"] = WordTable(path)
    return _memos[path, "table"]
