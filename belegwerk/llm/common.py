"""Shared parts: table access, written intermediate tables, and a vectorised word hasher.

Words are maximal runs of code points other than U+0020 and U+0009 to U+000D. All of these
are single bytes in UTF-8, so words are found on the bytes of a whole Arrow batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..plans.store import fresh_path, least_hashed, written  # noqa: F401  for the operators

#: Bytes of text that one numpy step works on, which needs some sixty times that for its arrays; a
#: longer document is a step of its own.
STEP_BYTES = 1 << 19

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
PLAIN = np.arange(256, dtype=np.uint8)

_U = np.uint64
_RNG = np.random.default_rng(0x5EED)
_BYTE_KEYS = _RNG.integers(0, 2**64, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
#: A second family of keys and multipliers, for hashes of 128 bits.
_OTHER_KEYS = np.random.default_rng(0xD15C).integers(0, 2**64, 256, dtype=np.uint64) | _U(1)
_OTHER = 0xC2B2AE3D27D4EB4F | 1
_OTHER_INV = pow(_OTHER, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64 bits."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        grown = np.full(max(n, STEP_BYTES), base, dtype=np.uint64)
        grown[0] = 1
        have = np.multiply.accumulate(grown)
        if n <= 4 * STEP_BYTES:
            _POWERS[base] = have
    return have[:n]


class Words:
    """Words of some documents: byte spans, the first word of each document, and hashes."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        n = len(data)
        self.data, self.bounds = data, bounds
        solid = ~SPACE[data]
        first = np.zeros(n + 1, dtype=bool)
        first[bounds] = True
        left, right = np.empty(n, dtype=bool), np.empty(n, dtype=bool)
        left[:1], left[1:] = True, ~solid[:-1]
        right[-1:], right[:-1] = True, ~solid[1:]
        self.starts = np.flatnonzero(solid & (left | first[:n]))
        self.ends = np.flatnonzero(solid & (right | first[1:])) + 1
        #: words of document i: self.at[i] to self.at[i + 1]
        self.at = np.searchsorted(self.starts, bounds)

    def hashes(self, table: np.ndarray = PLAIN, other: bool = False) -> np.ndarray:
        """A 64-bit hash of each word, its bytes seen through ``table``: a polynomial over keyed
        bytes from one prefix sum, moved to a common origin, then mixed with the length. ``other``
        gives one of other keys."""
        keys, base, inverse = (_OTHER_KEYS, _OTHER, _OTHER_INV) if other else (_BYTE_KEYS, _BASE, _BASE_INV)
        n = len(self.data)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(keys[table][self.data] * _powers(base, n), out=sums[1:])
        h = (sums[self.ends] - sums[self.starts]) * _powers(inverse, n)[self.starts]
        return mix(h + (self.ends - self.starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def steps(texts: pa.Array, step_bytes: int = STEP_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, row after the last, Words) over an Arrow string column; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("")
    n = len(texts)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, dtype=kind)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + step_bytes, side="right")) - 1)
        yield i, j, Words(raw[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def chained(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes, in order; empty when there are fewer."""
    if len(h) < k:
        return h[:0]
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out = mix(out * _U(0x2545F4914F6CDD1D) + h[i : len(h) - k + 1 + i])
    return out


def pair_hash(h: np.ndarray) -> bytes:
    """A 128-bit digest of a sequence of 64-bit hashes."""
    import hashlib

    return hashlib.blake2b(h.tobytes(), digest_size=16).digest()


def rolled(h: np.ndarray, k: int, other: bool = False) -> np.ndarray:
    """As ``chained``, in a fixed number of passes for any ``k``: a polynomial over the word
    hashes from one prefix sum, each window moved to a common origin."""
    if len(h) < k:
        return h[:0]
    base, inverse = (_OTHER, _OTHER_INV) if other else (_BASE, _BASE_INV)
    n = len(h)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(h * _powers(base, n), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * _powers(inverse, n)[: n - k + 1] + _U(k))
