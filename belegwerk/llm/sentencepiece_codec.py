"""SentencePiece encoding and decoding in numpy, over batches of equal-length words.

All substrings of a batch of words, up to the longest piece, are hashed from prefix sums and
looked up among the sorted piece keys at once. From that table of scores

- a unigram model is decoded by Viterbi: the words advance together, one place at a time, the
  best start of each place is a vectorised maximum and its backpointer is stored;
- a BPE model applies its merges: the words advance together, one merge at a time, the best
  adjacent pair of each word being a vectorised maximum over the same scores. The best sum of
  piece scores is not what a BPE model returns, so Viterbi would give other ids there.

Words are cut before each space mark. Code points outside the model fall back to bytes. A batch of
words costs their length squared by merges, so a text with a word of over LONGEST code points is
encoded by the library itself, whose queue of merges takes n log n: ids are the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ship import map_arrow
from .common import _BASE, _BASE_INV, _BYTE_KEYS, _powers, mix
from .tokens import Memo

MARK = "▁"
MEMO = 500_000
LONGEST = 256
_MARK = MARK.encode()
_U = np.uint64


def _coded(chars: np.ndarray) -> np.ndarray:
    """Keyed values of code points."""
    return mix(chars.astype(np.uint64) + _U(0x51ED270B))


def _hashes(chars: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the substrings of up to ``width`` code points of each row, and where each has its
    column: at[start, n - 1], -1 beyond the row's end."""
    rows, length = chars.shape
    sums = np.zeros((rows, length + 1), dtype=np.uint64)
    coded = _coded(chars)
    for i in range(length):
        sums[:, i + 1] = sums[:, i] * _U(_BASE) + coded[:, i]
    power = _powers(_BASE, width + 1)
    parts, at, k = [], np.full((length, width), -1, dtype=np.int64), 0
    for n in range(1, min(width, length) + 1):
        parts.append(mix(sums[:, n:] - sums[:, :-n] * power[n] + _U(n)))
        at[: length - n + 1, n - 1] = np.arange(k, k + length - n + 1)
        k += length - n + 1
    return np.concatenate(parts, axis=1), at


class Codec:
    """Encoder and decoder of a model file of the sentencepiece library."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(n)]
        self.pieces = pieces
        plain = [i for i in range(n) if not (self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i) or self.library.is_unused(i))]
        self.scores = np.array([self.library.get_score(i) for i in range(n)])
        self.bytes = np.full(256, -1, dtype=np.int64)
        for i in range(n):
            if self.library.is_byte(i):
                self.bytes[int(pieces[i][3:-1], 16)] = i
        self.unknown = self.library.unk_id()
        self.width = max(len(pieces[i]) for i in plain)
        self.bpe = _model_type(self.library.serialized_model_proto()) == 2
        keys = np.zeros(len(plain), dtype=np.uint64)
        sizes = np.array([len(pieces[i]) for i in plain])
        ids = np.array(plain)
        for size in np.unique(sizes):
            of = np.flatnonzero(sizes == size)
            chars = np.array([[ord(c) for c in pieces[i]] for i in ids[of]], dtype=np.uint32)
            hashes, at = _hashes(chars, size)
            keys[of] = hashes[:, at[0, size - 1]]
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        self.memo = Memo()
        raw = [p.replace(MARK, " ").encode() for p in pieces]
        for b, i in enumerate(self.bytes.tolist()):
            if i >= 0:
                raw[i] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_sizes = np.array([len(r) for r in raw])
        self.raw_at = np.cumsum(self.raw_sizes) - self.raw_sizes

    def _found(self, chars: np.ndarray) -> np.ndarray:
        """id[row, start, n - 1] of the piece there, -1 where there is none."""
        h, at = _hashes(chars, self.width)
        where = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        ids = np.concatenate([np.where(self.keys[where] == h, self.ids[where], -1), np.full((len(chars), 1), -1)], axis=1)
        return ids[:, at]

    def _viterbi(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best sums of scores; an unknown code point is one step at a fixed low score."""
        rows, length = chars.shape
        found = self._found(chars)
        scores = np.where(found >= 0, self.scores[found], -np.inf)
        low = self.scores.min() - 10
        none = found[:, :, 0] < 0
        scores[:, :, 0][none] = low
        best = np.full((rows, length + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((rows, length + 1), dtype=np.int64)
        for end in range(1, length + 1):
            width = min(self.width, end)
            starts = end - 1 - np.arange(width)
            sums = best[:, starts] + scores[:, starts, np.arange(width)]
            pick = sums.argmax(axis=1)
            best[:, end], back[:, end] = sums[np.arange(rows), pick], pick + 1
        cuts = np.zeros((rows, length + 1), dtype=bool)
        at = np.full(rows, length)
        while (at > 0).any():
            cuts[np.arange(rows), at] = True
            at = at - np.where(at > 0, back[np.arange(rows), at], 0)
        cuts[:, 0] = False  # where a row was done before the others
        return self._ids(chars, found, cuts)

    def _merge(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges, the best score first and the leftmost of equals, until none is left."""
        rows, length = chars.shape
        found = self._found(chars)
        cuts = np.ones((rows, length + 1), dtype=bool)
        cuts[:, 0] = False
        live, ends = np.arange(rows), np.tile(np.arange(1, length + 1), (rows, 1))
        while len(live) and ends.shape[1] > 1:
            starts = np.concatenate([np.zeros((len(live), 1), dtype=np.int64), ends[:, :-2]], axis=1)
            size = ends[:, 1:] - starts
            fits = size <= self.width
            ids = np.where(fits, found[live[:, None], starts, np.minimum(size, self.width) - 1], -1)
            score = np.where(ids >= 0, self.scores[ids], -np.inf)
            at = score.argmax(axis=1)
            on = score[np.arange(len(live)), at] > -np.inf
            live, ends, at = live[on], ends[on], at[on]
            cuts[live, ends[np.arange(len(live)), at]] = False
            keep = np.arange(ends.shape[1] - 1)[None, :]
            ends = np.take_along_axis(ends, keep + (keep >= at[:, None]), axis=1)
        return self._ids(chars, found, cuts)

    def _ids(self, chars: np.ndarray, found: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows in one array, and how many each row has."""
        row, end = np.nonzero(cuts)
        start = np.concatenate([[0], end[:-1]])
        start[np.flatnonzero(np.diff(row, prepend=-1))] = 0
        ids = found[row, start, end - start - 1]
        counts = np.bincount(row, minlength=len(chars))
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            each = {i: self._fallback(int(chars[row[i], start[i]])) for i in odd.tolist()}
            sizes = np.ones(len(ids), dtype=np.int64)
            sizes[odd] = [len(x) for x in each.values()]
            wide, starts = np.repeat(ids, sizes), np.cumsum(sizes) - sizes
            for i, x in each.items():
                wide[starts[i] : starts[i] + len(x)] = x
            counts = np.bincount(row, sizes, minlength=len(chars)).astype(np.int64)
            ids = wide
        return ids.astype(np.uint32), counts

    def _fallback(self, code: int) -> list[int]:
        ids = [int(self.bytes[b]) for b in chr(code).encode("utf-8", "surrogatepass")]
        return ids if min(ids) >= 0 else [self.unknown]

    def _learn(self, keys: np.ndarray, words: Sequence[str]) -> None:
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for length, some in by.items():
            step = max(1, 1_000_000 // (length * self.width))
            for lo in range(0, len(some), step):
                part = some[lo : lo + step]
                chars = np.frombuffer("".join([words[i] for i in part]).encode("utf-32-le"), dtype=np.uint32).reshape(len(part), length)
                ids, counts = self._merge(chars) if self.bpe else self._viterbi(chars)
                self.memo.add(keys[part], counts, ids)

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of each text, in order. The normalised texts are cut before each run of space
        marks, all of them at once on their bytes, and words are looked up by their hashes."""
        plain = [self.library.normalize(t).encode() for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(p) for p in plain])]).astype(np.int64)
        data, n = np.frombuffer(b"".join(plain), dtype=np.uint8), int(bounds[-1])
        if not n:
            return [np.zeros(0, dtype=np.uint32) for _ in texts]
        mark = np.zeros(n + 3, dtype=bool)
        mark[: max(n - 2, 0)] = (data[:-2] == _MARK[0]) & (data[1:-1] == _MARK[1]) & (data[2:] == _MARK[2])
        first = mark[:n].copy()
        first[3:] &= ~mark[: n - 3]
        first[bounds[:-1][bounds[:-1] < n]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], n)
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        word_at = np.searchsorted(starts, bounds)
        long = np.flatnonzero(points[ends] - points[starts] > LONGEST)
        whole = {i: np.array(self.library.encode(texts[i], num_threads=1), dtype=np.uint32) for i in sorted(set((np.searchsorted(word_at, long, side="right") - 1).tolist()))}
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_KEYS[data] * _powers(_BASE, n), out=sums[1:])
        h = (sums[ends] - sums[starts]) * _powers(_BASE_INV, n)[starts]
        h = mix(h + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93)) | _U(1)
        used = np.ones(len(starts), dtype=bool)
        for i in whole:
            used[word_at[i] : word_at[i + 1]] = False
        slot = np.full(len(starts), -1, dtype=np.int64)
        slot[used] = self.memo.find(h[used])
        missed = np.flatnonzero(used & (slot < 0))
        if len(missed):
            if len(self.memo) + len(missed) > MEMO:
                self.memo.clear()
                missed = np.flatnonzero(used)
            keys, f = np.unique(h[missed], return_index=True)
            raw = data.tobytes()
            self._learn(keys, [raw[a:b].decode() for a, b in zip(starts[missed[f]].tolist(), ends[missed[f]].tolist())])
            slot[missed] = self.memo.find(h[missed])
        ids, stops = self.memo.ids(slot[used])
        edge = np.concatenate([[0], stops])[np.concatenate([[0], np.cumsum(used)])[word_at]]
        return [whole[i] if i in whole else ids[edge[i] : edge[i + 1]] for i in range(len(texts))]

    def decode_all(self, rows: Sequence[np.ndarray]) -> list[bytes]:
        """The texts of rows of ids, as UTF-8: pieces and bytes joined, space marks as spaces, the
        first dropped; what is no UTF-8 is replaced."""
        ids = np.concatenate([np.zeros(0, dtype=np.int64), *rows]).astype(np.int64)
        sizes = self.raw_sizes[ids]
        ends = np.cumsum(sizes)
        flat = self.raw[np.repeat(self.raw_at[ids] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        edge = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)].tolist()
        out = []
        for a, b in zip(edge[:-1], edge[1:]):
            text = flat[a:b].decode("utf-8", "replace").encode()
            out.append(text[1:] if text.startswith(b" ") else text)
        return out

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_all([ids])[0].decode()


def _model_type(proto: bytes) -> int:
    """trainer_spec.model_type of a serialised model: 1 unigram, 2 BPE (1 where it is unset)."""

    def fields(b: bytes):
        i = 0

        def number():
            nonlocal i
            n = shift = 0
            while True:
                c = b[i]
                i += 1
                n |= (c & 127) << shift
                shift += 7
                if c < 128:
                    return n

        while i < len(b):
            tag = number()
            if tag & 7 == 0:
                yield tag >> 3, number()
            elif tag & 7 == 2:
                n = number()
                yield tag >> 3, b[i : i + n]
                i += n
            else:
                n = {1: 8, 5: 4}[tag & 7]
                yield tag >> 3, b[i : i + n]
                i += n

    for tag, value in fields(proto):
        if tag == 2:
            return next((v for t, v in fields(value) if t == 3), 1)
    return 1


_CODECS: dict[str, Codec] = {}


def codec(name: str) -> Codec:
    """This worker's codec of a model file, kept from task to task."""
    if name not in _CODECS:
        import public_tokenizers

        _CODECS[name] = Codec(public_tokenizers.path(name))
    return _CODECS[name]


def _encoded(name: str, keep: bool):
    def run(batches):
        coder = codec(name)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids = coder.encode(texts)
                cols = {
                    "doc_id": part.column(0),
                    "n_pieces": pa.array([len(x) for x in ids], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(x.astype("<u4")) for x in ids], pa.int64()),
                    "decoded_crc32": pa.array([zlib.crc32(x) for x in coder.decode_all(ids)], pa.int64()),
                }
                if keep:
                    cols["ids"] = pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)

    return run


def encoded(docs: DataFrame, model: str = "piece_bpe_32k.model", keep_ids: bool = True) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> doc_id, n_pieces, ids_crc32, decoded_crc32 (, ids).

    ids are those of the model for the whole text; ids_crc32 is over them as little-endian
    32-bit numbers, decoded_crc32 over the UTF-8 of what they decode to. Null and empty texts
    have no ids. Repeated rows are encoded each; other columns are ignored; an empty table gives
    an empty result. Row by row: nothing is shuffled.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(texts, _encoded(model, keep_ids), "doc_id long, n_pieces long, ids_crc32 long, decoded_crc32 long" + ", ids array<int>" * keep_ids)


def decoded(rows: DataFrame, model: str = "piece_bpe_32k.model") -> DataFrame:
    """``rows(doc_id, ids, ...)`` -> doc_id, text: what the ids decode to; null ids give null."""

    def run(batches):
        coder = codec(model)
        for batch in batches:
            out = [None if x is None else coder.decode(np.array(x, dtype=np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return map_arrow(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")), run, "doc_id long, text string")
