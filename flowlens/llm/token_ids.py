"""Token ids of whole batches with a ready-made tokenizer of the ``tokenizers`` library.

The library meets each distinct piece of text once a worker process: the word vocabulary's pre-tokenizer never joins text
across white space, nor ASCII letters, digits and signs of one word, so texts are cut there, lower-cased in ASCII (as the
vocabulary does itself) and looked up by hash. Words with anything but printable ASCII, or with an apostrophe, stay whole;
texts that contain a special token's string go to the library whole. For other tokenizers use ``plain=True``.
"""

from __future__ import annotations

import os

import numpy as np

from flowlens.llm import textcore as tc

#: Distinct pieces remembered by a worker; beyond it, it starts anew.
REMEMBERED = 1 << 21

_CLASS = np.full(256, 4, np.uint8)  # 0 white space, 1 letter, 2 digit, 3 sign, 4 keeps its word whole
_CLASS[0x21:0x7F] = 3
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[tc.IS_SPACE] = 0
_CLASS[ord("'")] = 4


class Encoder:
    """Encodes batches; one for each tokenizer file and worker process."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str, plain: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.plain = plain
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.tokens = np.zeros(0, np.uint32)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        if len(self.hashes) > REMEMBERED:
            self.forget()
        got = self._library(texts)
        length = np.array([len(x) for x in got], np.int64)
        first = len(self.tokens) + np.cumsum(length) - length
        self.tokens = np.concatenate([self.tokens, np.array([i for x in got for i in x], np.uint32)])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.first, self.length = (np.insert(a, at, b) for a, b in
                                                ((self.hashes, hashes), (self.first, first), (self.length, length)))

    def units(self, low: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of each piece of text that is looked up by itself."""
        starts, ends, _ = tc.words(low, off)
        kind = _CLASS[low]
        full = np.concatenate([[0], np.cumsum(kind == 4)])
        whole = full[ends] > full[starts]
        change = np.zeros(len(low) + 1, np.int8)
        change[starts[whole]] = 1
        change[ends[whole]] -= 1
        cut = (kind == 2)
        cut[1:] |= (kind[1:] != kind[:-1]) | (kind[:-1] == 2)
        cut &= (np.cumsum(change[:-1], dtype=np.int8) == 0) & (kind != 0)
        cut[starts] = True
        begins = np.flatnonzero(cut)
        word_end = ends[np.searchsorted(starts, begins, "right") - 1] if len(starts) else begins
        following = np.concatenate([begins[1:], [len(low)]]) if len(begins) else begins
        return begins, np.minimum(word_end, following)

    def encode(self, data: np.ndarray, off: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents end to end, each followed by ``end``, and each document's first place."""
        raw = data.tobytes()
        odd = [i for i in range(len(off) - 1) if any(s in raw[off[i]:off[i + 1]] for s in self.special)] \
            if any(s in raw for s in self.special) else []
        if self.plain:
            odd = list(range(len(off) - 1))
        low = tc.LOWER[data]
        begins, ends = self.units(low, off)
        h = tc.span_hash(low, begins, ends, 17)
        order = np.argsort(h)
        k = h[order]
        new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(new) - 1
        known = k[new]
        for _ in range(2):
            at = np.minimum(np.searchsorted(self.hashes, known), max(len(self.hashes) - 1, 0))
            missing = self.hashes[at] != known if len(self.hashes) else np.ones(len(known), bool)
            if not missing.any():
                break
            if len(self.hashes) > REMEMBERED:
                self.forget()
                missing[:] = True
            some = order[new][missing]
            text = low.tobytes()
            self._learn(known[missing], [text[a:b].decode() for a, b in zip(begins[some].tolist(), ends[some].tolist(), strict=True)])
        at = np.searchsorted(self.hashes, known)[which] if len(known) else np.zeros(0, np.int64)
        n, first = self.length[at], self.first[at]
        place = np.concatenate([[0], np.cumsum(n)])
        ids = self.tokens[np.repeat(first - place[:-1], n) + np.arange(place[-1])]
        io = place[np.searchsorted(begins, off)]
        if odd:
            parts = np.split(ids, io[1:-1])
            for i, x in zip(odd, self._library([raw[off[i]:off[i + 1]].decode() for i in odd]), strict=True):
                parts[i] = np.array(x, np.uint32)
            io = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            ids = np.concatenate(parts) if parts else ids
        if end is not None:
            ids = np.insert(ids, io[1:], np.uint32(end))
            io = io + np.arange(len(io))
        return ids, io
