"""Token ids of whole Arrow columns, by merges over batches of equal-length segments.

The public word-level tokenizer drops white space, lower-cases, and cuts words into runs of
letters, single digits and runs of other characters; merges never cross these segments. So a
text's ids are its segments' ids in order. Distinct segments of a step are looked up by hash
among those seen before by this worker; new ones of equal length are merged together in numpy.
Words with other bytes than printable ASCII and Latin-1 letters go to the tokenizer itself, and
so do whole texts that hold an added token, which is matched before any cut.
The memo starts anew where a step would take it beyond MEMO segments; a single step with more
holds what it needs, for its table grows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import _BASE, _BASE_INV, _BYTE_KEYS, _powers, mix, steps

MEMO = 1_500_000
SLOTS = 1 << 18
LONGEST = 48
_NONE = np.int32(2**31 - 1)

#: Byte classes: 0 space, 1 letter, 2 digit, 3 other printable, 4 left to the tokenizer.
_CLASS = np.full(256, 4, dtype=np.uint8)
_CLASS[0x21:0x7F] = 3
_CLASS[0x30:0x3A] = 2
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = 1
_CLASS[0x27] = 4
_CLASS[[0x20, 9, 10, 11, 12, 13]] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


class PairTable:
    """(left id, right id) -> rank of the merge, by open addressing; _NONE where there is none."""

    def __init__(self, left: np.ndarray, right: np.ndarray, bits: int = 19):
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << bits, _NONE, dtype=np.int32)
        for r, k in enumerate((left.astype(np.int64) << 32 | right).tolist()):
            i = self._slot(k)
            while self.keys[i] != -1 and self.keys[i] != k:
                i = (i + 1) & self.mask
            if self.keys[i] == -1:
                self.keys[i], self.ranks[i] = k, r

    def _slot(self, k):
        if isinstance(k, int):
            return ((k * 0x9E3779B97F4A7C15) % 2**64 >> 40) & self.mask
        return ((k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) & np.uint64(self.mask)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        k = left.astype(np.int64) << 32 | right
        at = self._slot(k)
        found = self.keys[at]
        out = np.where(found == k, self.ranks[at], _NONE)
        open_ = np.flatnonzero((found != k) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            found = self.keys[at[open_]]
            hit = found == k[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


def merged(symbols: np.ndarray, table: PairTable, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge every row of ``symbols`` (rows of one length): the lowest rank first, the leftmost of
    equals. Returns the symbols, left-aligned, and how many each row has."""
    n, width = symbols.shape
    out, counts = symbols.copy(), np.full(n, width, dtype=np.int64)
    if width < 2:
        return out, counts
    live = np.arange(n)
    s = out.copy()
    ranks = table.get(s[:, :-1].ravel(), s[:, 1:].ravel()).reshape(n, width - 1)
    while True:
        at = ranks.argmin(axis=1)
        best = ranks[np.arange(len(live)), at]
        on = best != _NONE
        if not on.all():
            done = ~on
            out[live[done], : s.shape[1]] = s[done]
            counts[live[done]] = s.shape[1]
            live, s, ranks, at, best = live[on], s[on], ranks[on], at[on], best[on]
        if not len(live):
            return out, counts
        rows, m = np.arange(len(live)), s.shape[1] - 1
        keep = np.arange(m)[None, :] + (np.arange(m)[None, :] > at[:, None])
        s = np.take_along_axis(s, keep, axis=1)
        s[rows, at] = joined[best]
        if m == 1:
            out[live, :1], counts[live] = s, 1
            return out, counts
        ranks = np.take_along_axis(ranks, keep[:, :-1], axis=1)
        right = np.minimum(at, m - 2)
        here = at < m - 1
        ranks[rows[here], right[here]] = table.get(s[rows[here], at[here]], s[rows[here], at[here] + 1])
        before = at > 0
        ranks[rows[before], at[before] - 1] = table.get(s[rows[before], at[before] - 1], s[rows[before], at[before]])


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Memo:
    """Segments by a 64-bit hash that is not 0 -> their ids, by open addressing in numpy."""

    def __init__(self, slots: int = SLOTS):
        self.least = slots
        self.clear()

    def clear(self) -> None:
        self._table(self.least)
        self.at = np.zeros(1, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)

    def __len__(self) -> int:
        return len(self.at) - 1

    def _table(self, size: int) -> None:
        self.keys = np.zeros(size, dtype=np.uint64)
        self.slots = np.zeros(size, dtype=np.int32)

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(20) & np.uint64(len(self.keys) - 1)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Segment numbers of the keys, -1 for those not seen; 0 marks a free slot of the table."""
        at, last = self._place(keys), len(self.keys) - 1
        seen = self.keys[at]
        out = np.where(seen == keys, self.slots[at], -1)
        open_ = np.flatnonzero((seen != keys) & (seen != 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & last
            seen = self.keys[at[open_]]
            hit = seen == keys[open_]
            out[open_[hit]] = self.slots[at[open_[hit]]]
            open_ = open_[~hit & (seen != 0)]
        return out

    def add(self, keys: np.ndarray, counts: np.ndarray, flat: np.ndarray) -> None:
        """Add keys not seen so far, each with ``counts`` ids of ``flat``, in order. The table grows
        so that half of it stays free."""
        slots = np.arange(len(self), len(self) + len(keys), dtype=np.int64)
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(counts)])
        self.flat = np.concatenate([self.flat, flat])
        if 2 * len(self) > len(self.keys):
            used = np.flatnonzero(self.keys)
            keys, slots = np.concatenate([self.keys[used], keys]), np.concatenate([self.slots[used], slots])
            self._table(1 << int(4 * len(keys) - 1).bit_length())
        at, last = self._place(keys), len(self.keys) - 1
        left = np.arange(len(keys))
        while len(left):
            free = left[self.keys[at[left]] == 0]
            self.keys[at[free]] = keys[free]
            won = free[self.keys[at[free]] == keys[free]]
            self.slots[at[won]] = slots[won]
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & last

    def ids(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the segments, in one array, and where each ends."""
        sizes = self.at[slot + 1] - self.at[slot]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.at[slot] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)], ends


class WordEncoder:
    def __init__(self, name: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        path = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.pairs = PairTable(np.array([vocab[a] for a, _ in merges]), np.array([vocab[b] for _, b in merges]))
        self.joined = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        chars = _byte_chars()
        self.inner = np.array([vocab[chars[b]] for b in range(256)], dtype=np.int32)
        self.last = np.array([vocab[chars[b] + "</w>"] for b in range(256)], dtype=np.int32)
        self.memo = Memo(SLOTS)

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, simple: np.ndarray, raw: np.ndarray) -> None:
        n = len(keys)
        counts = np.zeros(n, dtype=np.int64)
        rows: list[tuple[np.ndarray, np.ndarray]] = []
        for width in np.unique(sizes[simple]).tolist():
            of = np.flatnonzero(simple & (sizes == width))
            cells = data[starts[of][:, None] + np.arange(width)]
            symbols = self.inner[cells]
            symbols[:, -1] = self.last[cells[:, -1]]
            ids, counts[of] = merged(symbols, self.pairs, self.joined)
            rows.append((of, ids))
        odd = np.flatnonzero(~simple)
        made = []
        if len(odd):
            whole = raw.tobytes()
            words = [whole[a : a + b].decode("utf-8", "replace") for a, b in zip(starts[odd].tolist(), sizes[odd].tolist())]
            made = [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
            counts[odd] = [len(x) for x in made]
        ends = np.cumsum(counts)
        flat = np.zeros(int(ends[-1]) if n else 0, dtype=np.uint32)
        for of, ids in rows:
            used = np.arange(ids.shape[1])[None, :] < counts[of][:, None]
            flat[((ends - counts)[of][:, None] + np.arange(ids.shape[1]))[used]] = ids[used]
        for i, x in zip(odd.tolist(), made):
            flat[ends[i] - counts[i] : ends[i]] = x
        self.memo.add(keys, counts, flat)

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order; null is empty."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.fill_null("")
        whole = np.zeros(len(texts), dtype=bool)
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        if not whole.any():
            yield from self._segmented(texts)
            return
        rest = self._segmented(pc.if_else(pa.array(whole), "", texts))
        for i, ids in enumerate(rest):
            yield np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, dtype=np.uint32) if whole[i] else ids

    def _segmented(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of texts without added tokens."""
        for i, j, words in steps(texts):
            data, n = words.data, len(words.data)
            if not len(words.starts):
                yield from (np.zeros(0, dtype=np.uint32) for _ in range(j - i))
                continue
            low = _LOWER[data]
            kind = _CLASS[data]
            after = np.zeros(n, dtype=bool)
            after[1:] = data[:-1] == 0xC3
            lead = np.zeros(n, dtype=bool)
            lead[:-1] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] < 0xC0)
            tail = after & (data >= 0x80) & (data < 0xC0)
            sign = tail & ((data == 0x97) | (data == 0xB7))
            kind[lead | tail] = 1
            if sign.any():
                at = np.flatnonzero(sign)
                kind[at] = kind[at - 1] = 3
            low[tail & (data <= 0x9E) & (data != 0x97)] += 0x20
            # words with any byte that is not simple are units as they are
            odd = np.add.reduceat((kind == 4).astype(np.int32), words.starts) > 0
            odd |= words.ends - words.starts > LONGEST
            first = np.ones(n, dtype=bool)
            first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
            for w in np.flatnonzero(odd).tolist():
                first[words.starts[w] : words.ends[w]] = False
            first[words.starts] = True
            inside = np.zeros(n + 1, dtype=np.int8)
            inside[words.starts] += 1
            inside[words.ends] -= 1
            first &= np.cumsum(inside[:-1]) > 0
            starts = np.flatnonzero(first)
            unit_at = np.searchsorted(starts, words.starts)
            ends = np.empty_like(starts)
            ends[:-1] = starts[1:]
            ends[np.append(unit_at[1:], len(starts)) - 1] = words.ends
            simple = ~np.repeat(odd, np.diff(np.append(unit_at, len(starts))))

            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTE_KEYS[low] * _powers(_BASE, n), out=sums[1:])
            h = (sums[ends] - sums[starts]) * _powers(_BASE_INV, n)[starts]
            h = mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + simple.astype(np.uint64)) | np.uint64(1)
            slot = self.memo.find(h)
            missed = np.flatnonzero(slot < 0)
            if len(missed):
                if len(self.memo) + len(missed) > MEMO:
                    self.memo.clear()
                    missed = np.arange(len(h))
                keys, f = np.unique(h[missed], return_index=True)
                f = missed[f]
                self._learn(keys, low, starts[f], (ends - starts)[f], simple[f], data)
                slot[missed] = self.memo.find(h[missed])
            ids, stops = self.memo.ids(slot)
            edge = np.concatenate([[0], stops])[np.append(unit_at, len(starts))[words.at]]
            for d in range(j - i):
                yield ids[edge[d] : edge[d + 1]]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(name: str) -> WordEncoder:
    """This worker's encoder of a vocabulary file, kept from task to task."""
    if name not in _ENCODERS:
        _ENCODERS[name] = WordEncoder(name)
    return _ENCODERS[name]
