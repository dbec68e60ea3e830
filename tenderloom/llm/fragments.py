"""Encoding text by independent fragments, vectorised.

The bytes of many texts are cut at once; a fragment is known by a 64-bit hash
of its bytes; the ids of every distinct fragment are taken from the tokenizers
library once and kept in flat arrays; a text's ids are gathered from there.
At MOST kept fragments two of them share a hash with a probability of about
1e-8; the store then starts anew.
"""

from __future__ import annotations

import json
import re

import numpy as np

from tenderloom.llm.common import span_hashes

#: Distinct fragments that a worker keeps at most.
MOST = 1 << 19
WHITE = np.array([9, 10, 11, 12, 13, 32])


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def after_wide_space(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a white-space character other than ASCII's six ends before each
    position: the control characters 1C-1F, U+0085, U+00A0, U+1680,
    U+2000-200A, U+2028, U+2029, U+202F, U+205F and U+3000."""
    a, b, c = (data[np.maximum(at - k, 0)] for k in (1, 2, 3))
    two = (b == 0xC2) & ((a == 0x85) | (a == 0xA0))
    general = (c == 0xE2) & (((b == 0x80) & ((a <= 0x8A) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF))) | ((b == 0x81) & (a == 0x9F)))
    other = ((c == 0xE1) & (b == 0x9A) & (a == 0x80)) | ((c == 0xE3) & (b == 0x80) & (a == 0x80))
    return ((a >= 28) & (a <= 31)) | two | general | other


class Store:
    """ids of fragments by hash, in flat arrays."""

    def __init__(self, path: str, most: int = MOST):
        from tokenizers import Tokenizer

        self.told = json.loads(open(path, encoding="utf-8").read())
        self.added = {x["content"]: x["id"] for x in self.told["added_tokens"]}
        self.special = re.compile(b"|".join(re.escape(s.encode()) for s in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.one = re.compile(rb" ?[A-Za-z]+")
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.clear()

    def clear(self) -> None:
        self.keys, self.entry = np.zeros(1 << 16, np.uint64), np.full(1 << 16, -1, np.int32)
        self.starts, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def place(self, h: np.ndarray, entry: np.ndarray) -> None:
        """Puts new hashes into the table (open addressing, at most half full)."""
        if 2 * len(self.starts) + 2 * len(h) > len(self.keys):
            old, held = self.keys[self.entry >= 0], self.entry[self.entry >= 0]
            size = 1 << int(4 * (len(self.starts) + len(h))).bit_length()
            self.keys, self.entry = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
            h, entry = np.concatenate([old, h]), np.concatenate([held, entry.astype(np.int32)])
        mask = len(self.keys) - 1
        slot, left = (h & np.uint64(mask)).astype(np.int64), np.arange(len(h))
        while len(left):
            free = self.entry[slot[left]] < 0
            tried = left[free]
            self.keys[slot[tried]] = h[tried]  # of several for one slot the last stays
            won = self.keys[slot[tried]] == h[tried]
            self.entry[slot[tried[won]]] = entry[tried[won]]
            left = np.concatenate([left[~free], tried[~won]])
            slot[left] = (slot[left] + 1) & mask

    def entries(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        mask = len(self.keys) - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        out = self.entry[slot]
        left = np.flatnonzero((self.keys[slot] != h) & (out >= 0))
        while len(left):
            at = (slot[left] + 1) & mask
            slot[left], out[left] = at, self.entry[at]
            left = left[(self.keys[at] != h[left]) & (out[left] >= 0)]
        return out

    def learn(self, fragments: list[bytes]) -> None:
        """Appends the ids of new fragments to the arrays. One piece of ASCII
        letters goes to the library's model as it is; others through the whole
        library."""
        one, merge = self.one.fullmatch, self.tokenizer.model.tokenize
        rest = [f.decode() for f in fragments if not one(f)]
        other = iter(self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))
        ids: list[int] = []
        ends = []
        for f in fragments:
            ids += [t.id for t in merge(f.decode().replace(" ", "\u0120"))] if one(f) else next(other).ids
            ends.append(len(ids))
        self.ids = np.concatenate([self.ids, np.array(ids, np.int32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.array(ends, np.int64)])

    def lookup(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The entry of each byte range; unknown ones are learned."""
        if len(self.starts) > self.most:
            self.clear()
        h = span_hashes(data, starts, ends, False)
        found = self.entries(h)
        first = np.flatnonzero(found < 0)
        if len(first):
            missing = first
            first = first[np.argsort(h[first], kind="stable")]
            first = first[np.concatenate([[True], np.diff(h[first]) != 0])]
            entry = len(self.starts) - 1 + np.arange(len(first))
            self.learn([data[a:b].tobytes() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
            self.place(h[first], entry)
            found[missing] = self.entries(h[missing])
        return found

    def gather(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the entries, one after another, and how many each has."""
        n = self.starts[entry + 1] - self.starts[entry]
        return self.ids[ranges(self.starts[entry], n)], n
