"""Token ids of whole texts through the tokenizers library, each distinct word of a worker encoded once.

Both vocabularies split text at white space before any merge, so the ids of a text are those of its units
in a row. A unit is a run without ASCII white space; for the byte-level vocabulary it also takes the one
space before it, and white space left over forms units of its own, as the vocabulary's pattern does. Texts with other white space or with the marks of special tokens are encoded whole.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa

from cardflux.llm.textbytes import SPACES, Ranges, split_ranges

#: Units a worker remembers before it starts afresh, which bounds its memory.
REMEMBERED = 1_000_000
SUSPECT = np.zeros(256, bool)
SUSPECT[[*range(0x1C, 0x20), 0x3C, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = True
WHOLE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠　﻿]|<\\|")
SPACE = 0x20
END = "<|endoftext|>"
JOINED = 64


class Encoder:
    """Ids of the texts of a slice. One object per worker, see :func:`encoder`."""

    def __init__(self, path: str, byte_level: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.byte_level = byte_level
        self.end = self.tokenizer.token_to_id(END)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.places = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint16)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint16)

    def units(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte ranges that are encoded on their own, in order."""
        space = SPACES[data]
        starts, ends = split_ranges(space, bounds)
        if not self.byte_level or not len(data):
            return starts, ends
        first = np.zeros(len(data) + 1, bool)
        first[bounds] = True
        takes = ~first[starts] & (data[np.maximum(starts - 1, 0)] == SPACE)
        starts = starts - takes
        left = space.copy()
        left[starts[takes]] = False
        white_starts, white_ends = split_ranges(~left, bounds)
        # A run that a word follows, not through a space that the word takes, ends in a unit of its own.
        follows = ~first[white_ends] & ~space[np.minimum(white_ends, len(data) - 1)] & (white_ends < len(data))
        cut = follows & (white_ends - white_starts > 1)
        white_starts = np.concatenate([white_starts, white_ends[cut] - 1])
        white_ends = np.concatenate([np.where(cut, white_ends - 1, white_ends), white_ends[cut]])
        starts, ends = np.concatenate([starts, white_starts]), np.concatenate([ends, white_ends])
        order = np.argsort(starts, kind="stable")
        return starts[order], ends[order]

    def lookup(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each unit, and all their ids in a row."""
        # Units with marks of their own belong to texts that are encoded whole.
        texts = [text.replace("<|", "") for text in texts]
        # One call for many units: the end mark between them comes back as its own id.
        joined = [END.join(texts[i : i + JOINED]) for i in range(0, len(texts), JOINED)]
        marked = [np.array(e.ids, np.int32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        marked = np.concatenate([part for ids in marked for part in (ids, [self.end])])
        return np.diff(np.flatnonzero(marked == self.end), prepend=-1) - 1, marked[marked != self.end]

    def remember(self, keys: np.ndarray, texts: list[str]) -> None:
        lengths, flat = self.lookup(texts)
        places = np.cumsum(lengths, dtype=np.int64) - lengths + len(self.ids)
        keys = np.concatenate([self.keys, keys])
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.places = np.concatenate([self.places, places])[order]
        self.lengths = np.concatenate([self.lengths, lengths.astype(np.int32)])[order]
        self.ids = np.concatenate([self.ids, flat.astype(np.uint16)])

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slice's texts, and where each text's begin."""
        starts, ends = self.units(data, bounds)
        codes, distinct = pd.factorize(Ranges(data).hash(starts, ends))
        distinct = distinct.astype(np.uint64)
        if len(self.keys) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.keys, distinct)
        known = np.zeros(len(distinct), bool)
        if len(self.keys):
            known = self.keys[np.minimum(at, len(self.keys) - 1)] == distinct
        if not known.all():
            example = np.zeros(len(distinct), np.int64)
            example[codes[::-1]] = np.arange(len(codes))[::-1]
            raw = data.tobytes()
            new = np.flatnonzero(~known)
            self.remember(distinct[new], [raw[starts[i] : ends[i]].decode() for i in example[new]])
            at = np.searchsorted(self.keys, distinct)
        lengths, places = self.lengths[at][codes], self.places[at][codes]
        total = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        ids = self.ids[np.repeat(places - total[:-1], lengths) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, bounds)]

    def encode_texts(self, texts: pa.Array, data: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
        """One array of ids per text of a slice."""
        ids, begin = self.encode(data, bounds)
        out = [ids[begin[i] : begin[i + 1]] for i in range(len(begin) - 1)]
        suspects = np.unique(np.searchsorted(bounds, np.flatnonzero(SUSPECT[data]), "right") - 1)
        for i in suspects.tolist():
            text = texts[i].as_py()
            if WHOLE.search(text):
                out[i] = self.whole(text)
        return out


_made: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, byte_level: bool) -> Encoder:
    """The worker's encoder for this vocabulary."""
    if (path, byte_level) not in _made:
        _made[path, byte_level] = Encoder(path, byte_level)
    return _made[path, byte_level]


def vocabulary(name: str) -> str:
    """Where a public vocabulary lies on this machine; looked up by the task, as machines differ."""
    import public_tokenizers

    return public_tokenizers.path(name)
