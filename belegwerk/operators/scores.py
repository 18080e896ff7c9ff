"""Lexical and dense scores of questions and chunks, and the best of them, in one walk.

Whichever side has fewer rows is a matrix that every task has, in blocks of BLOCK rows; the other is
walked through once for each block. Texts are cut into grams and terms in array passes over their
characters: many words of a corpus occur once. A text's grams are counted in one array of all that there
are, without a sort. Dense scores of a batch are a matrix product of 4-byte numbers; what by its
error may be among the best is summed anew in 8 bytes. Only the best of each question leave a task.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import Analyzer
from ..functions.text import tokens as token_column
from ..plans.ship import map_arrow
from ..plans.store import written
from .dense import MAX_FEATURES
from .lexical import EPSILON, K1, B

BLOCK = 256
#: Terms and grams that a task counts before it sends them on, numbers of a product.
CACHED, COUNTED, CELLS = 500_000, 1_000_000, 2**24
#: Rows that a task holds before it keeps the best of them.
HELD = 20_000
#: Rows of an array pass over texts.
SLICE = 200
#: Columns of a block up to which a gram's products are summed one by one, not by a matrix product.
FEW = 12
#: Codes of characters and pairs of them up to which numbers are found in an array.
WIDE, HIGH = 1024, 4096
#: Places to which scores are ranked: sums in another order differ beyond.
PLACES = 12

_SPACES = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")  # white space to str.split alone
_TERM, _TERMS = re.compile(r"\w+"), re.compile(r"\w\w+")
_SPACE = [i for i in range(0x3001) if _SPACES.fullmatch(chr(i))]


def words(text: str) -> list[str]:
    return [w for w in _SPACES.split(text) if w] if _SEPARATORS.search(text) else text.split()


def terms(text: str) -> list[str]:
    return [t for t in _TERM.findall(text) if len(t) > 1]


def grams(word: str) -> list[str]:
    """As ``dense.char_grams``, of one lower-cased word."""
    p = f" {word} "
    n = len(p)
    out = [p[i : i + 2] for i in range(n - 1)] + [p[i : i + 3] for i in range(n - 2)]
    return out + [p[i : i + 4] for i in range(n - 3)] if n > 3 else out


class _Table:
    """Numbers above zero of pairs of numbers; zero for those that it has not. Pairs below the limits are
    cells of an array no larger than they need, others are in a dictionary."""

    def __init__(self, limit: tuple[int, int], kind=np.int32):
        self.limit, self.n, self.cells, self.far = limit, 0, np.zeros((1, 1), kind), {}

    def __getitem__(self, pair) -> np.ndarray:
        a, b = pair
        high, wide = self.cells.shape
        if not len(a) or a.max() < high and b.max() < wide:
            return self.cells.ravel().take(a * wide + b)
        near = (a < high) & (b < wide)
        out = self.cells.ravel().take(np.where(near, a * wide + b, 0))
        if self.far:
            out[~near] = _encoded(a[~near] << 32 | b[~near], lambda k: self.far.get(k, 0))
        else:
            out[~near] = 0
        return out

    def __setitem__(self, pair, number: np.ndarray) -> None:
        a, b = pair
        near = (a < self.limit[0]) & (b < self.limit[1])
        need = [int(x[near].max(initial=0)) + 1 for x in (a, b)]
        if any(n > m for n, m in zip(need, self.cells.shape)):
            old = self.cells
            self.cells = np.zeros([m if n <= m else min(most, n + n // 4) for n, m, most in zip(need, old.shape, self.limit)], old.dtype)
            self.cells[: old.shape[0], : old.shape[1]] = old
        self.cells[a[near], b[near]] = number[near]
        self.far.update(zip((a << 32 | b)[~near].tolist(), number[~near].tolist()))


def _encoded(keys: np.ndarray, number) -> np.ndarray:
    """The number of each key, looked up once for equal ones."""
    coded = pa.array(keys).dictionary_encode()
    return np.array([number(k) for k in coded.dictionary.to_pylist()], dtype=np.int64)[coded.indices.to_numpy()]


class _Grams:
    """Grams of texts as numbers, in array passes over their characters: a character has a code, two
    codes make a pair, a pair with nothing, a code or a pair after it a gram. Numbers are those of
    ``known`` if given, and grams that it has not are left out; else they are given as grams are met."""

    def __init__(self, known: list[str] | None):
        self.open = known is None
        self.fresh()
        for size in (2, 3, 4) if known else ():
            place = np.array([i for i, g in enumerate(known) if len(g) == size], dtype=np.int64)
            c = self._codes(_points("".join(known[i] for i in place.tolist())), True).reshape(-1, size)
            first = self._numbers(self.pairs, c[:, 0], c[:, 1], True)
            after = np.ones(len(c), np.int64) if size == 2 else c[:, 2] if size == 3 else self._numbers(self.pairs, c[:, 2], c[:, 3], True)
            self.tables[size][first, after] = place + 1

    def fresh(self) -> None:
        self.code = np.zeros(0x110000, np.int64)
        self.code[_SPACE] = 1
        self.chars = np.array([32], np.uint32)
        self.pairs, self.tables = _Table((WIDE, WIDE), np.int64), {2: _Table((HIGH, 2)), 3: _Table((HIGH, WIDE)), 4: _Table((HIGH, HIGH))}
        self.met, self.n = {t: [] for t in (self.pairs, *self.tables.values())}, 0

    def _codes(self, points: np.ndarray, grow: bool) -> np.ndarray:
        code = self.code[points]
        if grow and not code.all():
            new = np.unique(points[code == 0])
            self.code[new] = len(self.chars) + 1 + np.arange(len(new))
            self.chars = np.concatenate([self.chars, new])
            code = self.code[points]
        return code

    def _numbers(self, table: _Table, a: np.ndarray, b: np.ndarray, grow: bool, where: np.ndarray | None = None) -> np.ndarray:
        """Numbers of pairs; new ones get a number if the table may grow, ``where`` they are true."""
        number = table[a, b]
        if grow:
            new = np.flatnonzero(number == 0 if where is None else (number == 0) & where)
            if len(new):
                key = np.unique(a[new] << 32 | b[new])
                x, y, n = key >> 32, key & 2**32 - 1, table.n if table is self.pairs else self.n
                table[x, y] = n + 1 + np.arange(len(key))
                table.n, self.n = table.n + len(key), self.n + (table is not self.pairs) * len(key)
                self.met[table].append((x, y, n + np.arange(len(key))))
                number[new] = table[a[new], b[new]]
        return number

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Row and code of the characters of texts: words, and one space before each, which is of its
        row, and after the last."""
        points = _points(" ".join(["", *(t or "" for t in texts), ""]))
        row = np.repeat(np.arange(len(texts) + 1, dtype=np.int32), [*(len(t or "") + 1 for t in texts), 1])
        code = self._codes(points, self.open)
        keep = np.append((code[:-1] != 1) | (code[1:] != 1), True)
        return row[keep], code[keep]

    def cut(self, code: np.ndarray) -> np.ndarray:
        """For each character that was read the grams of 2, 3 and 4 from it on: their numbers plus one, and
        zero where there is none. A space is a gram's first or last character: others are in no table."""
        out = np.zeros((len(code), 3), np.int64)
        pair = self._numbers(self.pairs, code[:-1], code[1:], self.open)
        solid = code != 1 if self.open else None
        out[:-1, 0] = self._numbers(self.tables[2], pair, np.ones(len(pair), np.int64), self.open)
        out[:-2, 1] = self._numbers(self.tables[3], pair[:-1], code[2:], self.open, solid[1:-1] if self.open else None)
        out[:-3, 2] = self._numbers(self.tables[4], pair[:-2], pair[2:], self.open, solid[1:-2] & solid[2:-1] if self.open else None)
        return out.ravel()

    def of(self, row: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and number of each gram of what was read."""
        number = self.cut(code)
        at = np.flatnonzero(number)
        return row[at // 3], number[at] - 1

    def rows(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """As ``cut``, and where the numbers of each text end."""
        row, code = self.read(texts)
        return self.cut(code), 3 * np.searchsorted(row, np.arange(len(texts)), "right")

    def parts(self):
        """The grams met and their numbers, in parts."""
        first, second = (np.concatenate([x[i] for x in self.met[self.pairs]] or [np.zeros(0, np.int64)]) for i in (0, 1))
        for size, table in self.tables.items():
            for x, y, number in self.met[table]:
                for lo in range(0, len(x), 10_000):
                    p, after = x[lo : lo + 10_000] - 1, y[lo : lo + 10_000]
                    codes = [first[p], second[p], *([] if size == 2 else [after] if size == 3 else [first[after - 1], second[after - 1]])]
                    text = self.chars[np.stack(codes, 1) - 1].astype("<u4").tobytes().decode("utf-32-le")
                    yield [text[i : i + size] for i in range(0, len(text), size)], number[lo : lo + 10_000]

    def names(self) -> list[str]:
        named = {i: g for names, number in self.parts() for g, i in zip(names, number.tolist())}
        return [named[i] for i in range(self.n)]


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


class _Words:
    """Grams and terms of texts as numbers, those only that are known where they are given."""

    def __init__(self, grams_known: list[str] | None, terms_known: list[str] | None, cut_grams: bool, cut_terms: bool):
        self.gram = _Grams(grams_known) if cut_grams else None
        self.term, self.by_word = None if terms_known is None else pa.array(terms_known, pa.string()), cut_terms

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        return self.gram.read(texts)

    def of_grams(self, row, code) -> tuple[np.ndarray, np.ndarray]:
        return self.gram.of(row, code)

    def listed(self, texts: list[str | None], tokens: list | None) -> tuple[pa.Array, np.ndarray]:
        """The terms of texts, or their tokens by an analyzer, and where those of each text end."""
        if self.by_word:
            return _runs(texts)
        lists = [x or [] for x in tokens]
        return pa.array(chain.from_iterable(lists), pa.string()), np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))

    def of_terms(self, listed: pa.Array, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row and number of each known term, and how many terms each row has."""
        size = np.diff(ends, prepend=0)
        number = pc.fill_null(pc.index_in(listed, value_set=self.term), -1).to_numpy(zero_copy_only=False)
        return np.repeat(np.arange(len(ends)), size)[number >= 0], number[number >= 0], size


@lru_cache
def _in_words() -> np.ndarray:
    """Which characters are of terms."""
    every = np.arange(0x110000, dtype="<u4").view("<U1")
    return np.strings.isalnum(every) | (every == "_")


def _runs(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """The terms of texts, in order, and where those of each text end."""
    points = _points(" ".join(["", *(t or "" for t in texts), ""]))
    inside = _in_words()[points]
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, size = edge[::2], edge[1::2] - edge[::2]
    inside[start[size == 1]] = False
    start, size, points = start[size > 1], size[size > 1], points[inside]
    width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)  # bytes
    at = np.append(0, np.cumsum(width))[np.append(0, np.cumsum(size))].astype(np.int32)
    found = pa.StringArray.from_buffers(len(size), pa.py_buffer(at), pa.py_buffer(points.tobytes().decode("utf-32-le").encode()))
    return found, np.searchsorted(start, np.cumsum(np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))))


def _roomy(x: np.ndarray, n: int) -> np.ndarray:
    """``x`` with room for ``n`` numbers at least, zeros beyond its own."""
    return x if n <= len(x) else np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)])


def _rows(ends: np.ndarray):
    lo = 0
    for i, hi in enumerate(ends.tolist()):
        yield i, lo, hi
        lo = hi


def _each_once(held: np.ndarray, number: np.ndarray, ends: np.ndarray) -> None:
    """One more for each number of a row, however often it stands there."""
    for _, lo, hi in _rows(ends):
        held[number[lo:hi]] += 1  # of equal places one is written


def _spread(row, word, at, pool) -> tuple[np.ndarray, np.ndarray]:
    """Row and number of all that each word holds."""
    size = at[word + 1] - at[word]
    ends = np.cumsum(size)
    return np.repeat(row, size), pool[np.repeat(at[word] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def _counted(row, number, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of row and number, below ``n``, in order, and how often each stands there."""
    n = max(n, 1)
    kind = np.int32 if not len(row) or (int(row.max()) + 1) * n < 2**31 else np.int64  # half the width sorts twice as fast
    key = row.astype(kind) * kind(n) + number.astype(kind)
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    pairs = key[first]
    row = pairs // kind(n)
    return row.astype(np.int64), (pairs - row * kind(n)).astype(np.int64), np.diff(first, append=len(key))


@dataclass
class Vocabulary:
    """terms(term, df, idf), stats(n, avgdl), features(gram, idf) of a corpus of chunks."""

    terms: DataFrame
    stats: DataFrame
    features: DataFrame | None


def _texts(rows: DataFrame, id_: str, analyzer: Analyzer | None) -> DataFrame:
    own = [] if analyzer is None else [token_column(F.col("text"), analyzer).alias("tokens")]
    return rows.select(id_, F.lower("text").alias("text"), *own)


def vocabulary(chunks: DataFrame, analyzer: Analyzer | None = None, lexical: bool = True, dense: bool = True) -> Vocabulary:
    """``chunks(cidx, text)`` -> what their scores take from the corpus. The most frequent grams are the
    features, ties in order of the gram. A task sends on one row for each term or gram that it met."""
    by_word = lexical and analyzer is None

    def run(batches):
        known = _Words(None, None, dense, by_word)
        n, held, length = 0, 0, 0
        gram_cf, gram_df, terms, listed = np.zeros(1, np.int64), np.zeros(1, np.int32), [], 0  # narrow: it stays in a core's cache

        def rows(kind, names, cf, df):
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(names), pa.int32()), pa.array(names, pa.string()), pa.array(cf), pa.array(df)], ["kind", "name", "cf", "df"])

        def met_terms():
            for part in (b for t in terms for b in t.to_batches(10_000)):
                yield rows(1, part.column("name"), np.zeros(part.num_rows, np.int64), part.column("df"))

        def met_grams():
            for names, number in known.gram.parts() if dense else ():
                yield rows(0, names, gram_cf[number + 1], gram_df[number + 1].astype(np.int64))

        for batch in _sliced(batches):
            texts = batch.column(1).to_pylist()
            n, held = n + len(texts), held + len(texts) - batch.column(1).null_count
            if dense:
                gram, ends = known.gram.rows(texts)
                gram_cf, gram_df = _roomy(gram_cf, known.gram.n + 1), _roomy(gram_df, known.gram.n + 1)
                np.add.at(gram_cf, gram, 1)
                _each_once(gram_df, gram, ends)
            if lexical:
                found, ends = known.listed(texts, None if by_word else batch.column(2).to_pylist())
                length += len(found)
                coded = found.dictionary_encode()
                df = np.zeros(len(coded.dictionary), np.int64)
                _each_once(df, coded.indices.to_numpy(), ends)
                terms.append(pa.table({"name": coded.dictionary, "df": df}))
                listed += len(df)
            if listed > 2 * CACHED:
                terms = [_added_up(terms)]
                listed = terms[0].num_rows
                if listed > CACHED:
                    yield from met_terms()
                    terms, listed = [], 0
            if dense and known.gram.n > COUNTED:
                yield from met_grams()
                known.gram.fresh()
                gram_cf, gram_df = np.zeros(1, np.int64), np.zeros(1, np.int32)
        if terms:
            terms = [_added_up(terms)]
        yield from met_terms()
        yield from met_grams()
        for name, x in (("n", n), ("held", held), ("length", length)):
            yield rows(2, [name], np.array([x]), np.array([0]))

    met = map_arrow(_texts(chunks, "cidx", analyzer), run, "kind int, name string, cf long, df long")
    met = written(met.groupBy("kind", "name").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df")), "vocabulary")
    one = {r["name"]: r["cf"] for r in met.where("kind = 2").collect()}  # three rows
    n = F.lit(one.get("n", 0)).cast("long")
    spark = chunks.sparkSession
    stats = spark.range(1).select(n.alias("n"), F.lit(one["length"] / one["held"] if one.get("held") else None).cast("double").alias("avgdl"))
    raw = met.where("kind = 1").select(F.col("name").alias("term"), "df", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = F.lit(raw.agg(F.avg("raw")).first()[0]).cast("double")
    features = None
    if dense:
        kept = met.where("kind = 0").orderBy(F.col("cf").desc(), "name").limit(MAX_FEATURES)
        features = written(kept.select(F.col("name").alias("gram"), (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf")), "features")
    return Vocabulary(raw.select("term", "df", F.when(F.col("raw") < 0, mean * EPSILON).otherwise(F.col("raw")).alias("idf")), stats, features)


def _added_up(parts: list[pa.Table]) -> pa.Table:
    """``parts(name, df)`` as one, with a row for each name."""
    return pa.concat_tables(parts).group_by("name", use_threads=False).aggregate([("df", "sum")]).rename_columns(["name", "df"]).combine_chunks()


def _sliced(batches):
    """Batches of SLICE rows: their arrays stay in a core's cache."""
    for batch in batches:
        for lo in range(0, batch.num_rows, SLICE):
            yield batch.slice(lo, SLICE)


class _Scorer:
    """Scores of a batch of texts against the texts of one block. ``chunk_side``: the block's rows are
    chunks, and what is walked through are questions."""

    def __init__(self, given: dict):
        self.chunk_side, self.avgdl, self.by_word = given["chunk_side"], given["avgdl"], given["tokens"] is None
        self.n, self.dense, self.lexical = len(given["texts"]), given["grams"] is not None, given["terms"] is not None
        self.idf = given["idf"]
        gram = given["grams"] if self.dense else []
        term = given["terms"] if self.lexical else []
        self.words = _Words(gram, term, self.dense, self.lexical and self.by_word)
        if self.dense:
            r, g = self.words.of_grams(*self.words.read(given["texts"]))
            self.idf = np.append(0.0, self.idf)  # zero stands for no gram
            r, g, times = _counted(r, g + 1, len(self.idf))
            norm = np.sqrt(np.bincount(r, (times * self.idf[g]) ** 2, minlength=self.n))
            used = np.unique(g)
            self.place = np.full(len(self.idf), -1)  # no text of the block has the gram
            self.place[used] = np.arange(len(used))
            # products of a text's counts: the idf of its own side is in them too
            self.grams = np.zeros((len(used) + 1, self.n))
            self.grams[self.place[g], r] = times * self.idf[g] / np.where(norm == 0, 1.0, norm)[r] * self.idf[g]
            held = np.bincount(self.place[g], minlength=len(used))
            self.common = used[held > FEW]
            self.short = self.grams[:-1][held > FEW].astype(np.float32)
            self.rare = np.zeros(len(self.idf), bool)
            self.rare[used] = held <= FEW
            # of the others: the columns that have each, and their weights, one after another
            at, self.column = np.nonzero(np.where(np.append(held, 0)[:, None] <= FEW, self.grams, 0.0))
            self.own_weight, self.at = self.grams[at, self.column], np.searchsorted(at, np.arange(len(used) + 1))
            self.columns = np.ascontiguousarray(self.grams.T)
            self.squared, self.count = self.idf**2, np.zeros(len(self.idf))
        if self.lexical:
            r, t, times, length = self._terms(given["texts"], given["tokens"])
            weight = given["term_idf"][t] * (self._saturated(times, length[r]) if self.chunk_side else times)
            order = np.argsort(t, kind="stable")
            self.term_column, self.term_weight, self.term_at = r[order], weight[order], np.searchsorted(t[order], np.arange(len(term) + 1))

    def _saturated(self, tf, length):
        return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.avgdl))

    def _terms(self, texts, tokens):
        row, number, length = self.words.of_terms(*self.words.listed(texts, tokens))
        return *_counted(row, number, len(self.words.term)), length

    def _dense(self, texts) -> tuple[np.ndarray, float]:
        """Dense scores as sums of 4-byte numbers, and their greatest error: no score is above 1, and all
        terms are positive."""
        g, self.ends = self.words.gram.rows(texts)
        self.own, n = g, len(texts)
        self.norm = norm = np.ones(n)
        out, step = np.zeros((n, self.n), np.float32), max(1, CELLS // max(1, len(self.short)))
        count, block = self.count, np.zeros((min(n, step), len(self.short)), np.float32)
        squares = self.squared.take(g)
        for i, lo, hi in _rows(self.ends):
            mine = g[lo:hi]
            np.add.at(count, mine, 1.0)
            # a gram that stands there t times is met t times: t squared
            norm[i] = math.sqrt(squares[lo:hi] @ count.take(mine)) or 1.0
            block[i % step] = count.take(self.common)
            count[mine] = 0.0
            if i % step == step - 1 or i == n - 1:
                out[i - i % step : i + 1] = block[: i % step + 1] @ self.short
        few = np.flatnonzero(self.rare.take(g))
        r = np.searchsorted(self.ends, few, "right")
        for lo in range(0, len(few), CELLS // 8):  # a gram is in FEW columns at most
            part, row = few[lo : lo + CELLS // 8], r[lo : lo + CELLS // 8]
            i, j = _spread(np.arange(len(part)), self.place[g[part]], self.at, np.arange(len(self.column)))
            first, last = int(row[0]), int(row[-1]) + 1
            sums = np.bincount((row[i] - first) * self.n + self.column[j], self.own_weight[j], minlength=(last - first) * self.n)
            out[first:last] += sums.reshape(last - first, self.n)
        out /= norm[:, None].astype(np.float32)
        return out, (np.diff(self.ends, prepend=0).max(initial=0) + 12) * 2.0**-23

    def exact(self, row, column) -> np.ndarray:
        """Dense scores of pairs of the last batch's texts and the block's, by row: sums of 8-byte numbers. A
        column's weights lie together, so that they stay in a core's cache."""
        out, last, place = np.zeros(len(row)), -1, None
        for at, (i, j) in enumerate(zip(row.tolist(), column.tolist())):
            if i != last:
                last, place = i, self.place.take(self.own[self.ends[i - 1] if i else 0 : self.ends[i]])
            out[at] = self.columns[j].take(place).sum()
        return out / self.norm[row]

    def others(self, row, column, known, sums) -> np.ndarray:
        """As ``exact``, where the sums of the pairs ``known``, in order, have been made."""
        pair = row * self.n + column
        at = np.minimum(np.searchsorted(known, pair), max(len(known) - 1, 0))
        new = known[at] != pair if len(known) else np.ones(len(pair), bool)
        out = np.zeros(len(pair))
        out[~new], out[new] = sums[at[~new]], self.exact(row[new], column[new])
        return out

    def scores(self, texts, tokens, sharing: bool) -> tuple:
        """dense, its error, bm25 and whether a term is shared: a row for each text and a column for each of
        the block."""
        n = len(texts)
        dense = error = bm25 = shares = None
        if self.dense:
            dense, error = self._dense(texts)
        if self.lexical:
            r, t, times, length = self._terms(texts, tokens)
            w = times if self.chunk_side else self._saturated(times, length[r])
            bm25, shared = np.zeros((n, self.n)), np.zeros((n, self.n), bool)
            step = CELLS // 8 // max(1, self.n)
            for lo in range(0, len(t), step):  # a term is in all columns at most
                i, j = _spread(np.arange(lo, min(lo + step, len(t))), t[lo : lo + step], self.term_at, np.arange(len(self.term_column)))
                if not len(i):
                    continue
                first, last = int(r[i[0]]), int(r[i[-1]]) + 1
                cell, size = (r[i] - first) * self.n + self.term_column[j], (last - first) * self.n
                bm25[first:last] += np.bincount(cell, w[i] * self.term_weight[j], minlength=size).reshape(-1, self.n)
                if sharing:
                    shared[first:last] |= (np.bincount(cell, minlength=size) > 0).reshape(-1, self.n)
            shares = shared if sharing else None
        return dense, error, bm25, shares


def _candidates(key: np.ndarray, k: int, axis: int, slack: float, bar: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of what may be among the k greatest along an axis if values are off by half of
    ``slack``, and above ``bar``; none at minus infinity."""
    n = key.shape[axis]
    least = np.partition(key, n - k, axis=axis).take([n - k], axis=axis).astype(np.float64) if n > k else -np.inf
    return np.nonzero((key > -np.inf) & (key >= (least if bar is None else np.maximum(least, bar)) - slack))


def _ranking(row: np.ndarray, column: np.ndarray, value: np.ndarray, k: int, bar: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k greatest of each column, the first of equals; with ``bar`` those only that
    reach their column's."""
    if bar is not None:
        row, column, value = (x[value >= bar[column]] for x in (row, column, value))
    order = np.lexsort((row, -value, column))
    row, column, value = row[order], column[order], value[order]
    first = np.flatnonzero(np.diff(column, prepend=-1))
    place = np.arange(len(column)) - np.repeat(first, np.diff(np.append(first, len(column))))
    return row[place < k], column[place < k]


def _raise(top: np.ndarray, column: np.ndarray, value: np.ndarray) -> None:
    """Put values among the greatest so far of their columns, ``top``, a row for each column."""
    for c, v in zip(column.tolist(), value.tolist()):
        least = top[c].argmin()
        if v > top[c, least]:
            top[c, least] = v


def _best_held(held: list[tuple[np.ndarray, pa.RecordBatch]], by: tuple[str, ...], k: int, places: int) -> tuple[np.ndarray, pa.RecordBatch]:
    """Of rows of best(), with the column of each one's question, the k best of each question by each score."""
    column, rows = np.concatenate([x for x, _ in held]), pa.concat_batches([x for _, x in held])
    place = np.empty(len(column), np.int64)
    place[in_order(rows.column("cidx"))] = np.arange(len(column))
    kept = []
    for name in by:
        key = np.floor(rows.column(name).to_numpy() * 10.0**places + 0.5) / 10.0**places
        order = np.lexsort((place, -key, column))
        first = np.searchsorted(column[order], column[order])  # where the question begins
        kept.append(order[np.arange(len(order)) - first < k])
    kept = np.unique(np.concatenate(kept))
    return column[kept], rows.take(pa.array(kept))


def in_order(ids: pa.Array) -> np.ndarray:
    """Places in the order of ids, which may be structs."""
    columns, todo = [], [ids]
    while todo:
        x = todo.pop(0)
        if pa.types.is_struct(x.type):
            todo = [*x.flatten(), *todo]
        else:
            columns.append(x)
    names = [str(i) for i in range(len(columns))]
    return pc.sort_indices(pa.table(columns, names), [(c, "ascending") for c in names]).to_numpy()


def best(
    chunks: DataFrame, queries: DataFrame, known: Vocabulary, k: int, by: tuple[str, ...] = ("dense", "bm25"), analyzer: Analyzer | None = None, places: int = PLACES, matched: bool = False
) -> DataFrame:
    """``chunks(cidx, text)``, ``queries(query_id, text)`` -> query_id, cidx, dense, bm25: for each
    question at least the k best chunks by each score of ``by``, rounded to ``places``, ties in order of
    cidx. Chunks that share nothing score zero and are among them, unless ``matched``.
    """
    asked, held = queries.count(), chunks.count()
    chunk_side = held <= asked
    small, large = (chunks, queries) if chunk_side else (queries, chunks)
    small_id, large_id = ("cidx", "query_id") if chunk_side else ("query_id", "cidx")
    if chunk_side:  # short texts, much work for each: a table of one file would be one task
        large = large.repartition(max(2, 2 * large.sparkSession.sparkContext.defaultParallelism))
    parts = max(1, -(-min(asked, held) // BLOCK))
    rows, out = _texts(small, small_id, analyzer), None
    walked = _texts(large, large_id, analyzer)
    rows = written(rows, "block") if parts > 1 else rows
    shape = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c, df in (("query_id", queries), ("cidx", chunks)))
    for i in range(parts):
        some = rows if parts == 1 else rows.where(F.pmod(F.xxhash64(small_id), F.lit(parts)) == i)
        found = _block_best(some.toArrow(), walked, known, k, by, places, matched, chunk_side, analyzer, shape)  # about BLOCK rows
        out = found if out is None else out.unionByName(found)
    return out


def _block_best(block: pa.Table, walked: DataFrame, known: Vocabulary, k: int, by, places: int, matched: bool, chunk_side: bool, analyzer, shape: str) -> DataFrame:
    spark = walked.sparkSession
    ids = pa.concat_arrays(block.column(0).chunks) if block.num_rows else pa.nulls(0, block.column(0).type)
    if chunk_side:
        order = pa.array(in_order(ids))
        block, ids = block.take(order), ids.take(order)
    texts = block.column(1).to_pylist()
    lists = block.column(2).to_pylist() if analyzer else None
    given = {"chunk_side": chunk_side, "texts": texts, "tokens": lists, "avgdl": 1.0, "grams": None, "idf": None, "terms": None, "term_idf": None}
    if "dense" in by:
        table = known.features.toArrow().sort_by("gram")  # MAX_FEATURES rows at most
        given |= {"grams": table.column(0).to_pylist(), "idf": table.column(1).to_numpy()}
    if "bm25" in by:
        names = {t for x in lists for t in x or []} if analyzer else {t for x in texts for t in terms(x or "")}
        mine = spark.createDataFrame(pa.table({"term": pa.array(sorted(names), pa.string())}))  # from a list it is tasks in Python
        table = known.terms.join(F.broadcast(mine), "term").select("term", "idf").toArrow().sort_by("term")  # the terms of one block
        given |= {"terms": table.column(0).to_pylist(), "term_idf": table.column(1).to_numpy(), "avgdl": known.stats.first()["avgdl"] or 1.0}
    shared = spark.sparkContext.broadcast((given, ids))

    def run(batches):
        given, ids = shared.value
        scorer = _Scorer(given)
        tops = None if chunk_side else {name: np.full((scorer.n, k), -np.inf) for name in by}
        held: list[tuple[np.ndarray, pa.RecordBatch]] = []
        for batch in _sliced(batches if chunk_side else (b.take(pa.array(in_order(b.column(0)))) for b in batches)):
            if not scorer.n:
                continue
            dense, error, bm25, shares = scorer.scores(batch.column(1).to_pylist(), None if scorer.by_word else batch.column(2).to_pylist(), matched)
            chosen = []
            for name, value in (("dense", dense), ("bm25", bm25)):
                if value is not None:
                    bar, unit = tops and tops[name].min(axis=1), 10.0**-places
                    if matched:
                        value = np.where(value > 0 if name == "dense" else shares, value, -np.inf)
                    row, column = _candidates(value, k, 1 if chunk_side else 0, 2 * unit + (2 * error if name == "dense" else 0.0), bar)
                    sums = scorer.exact(row, column) if name == "dense" else value[row, column]
                    if name == "dense":
                        summed = row * scorer.n + column, sums
                    key = np.floor(sums * 10.0**places + 0.5) / 10.0**places
                    if not chunk_side:  # the k-th best of all slices, not of one
                        _raise(tops[name], column, key)
                        bar = tops[name].min(axis=1)
                    row, column = _ranking(column, row, key, k)[::-1] if chunk_side else _ranking(row, column, key, k, bar)
                    chosen.append(row * scorer.n + column)
            row, column = np.divmod(np.unique(np.concatenate(chosen)), scorer.n)
            if not len(row):
                continue
            mine, theirs = batch.column(0).take(pa.array(row)), ids.take(pa.array(column))
            values = [pa.nulls(len(row), pa.float64()) if dense is None else pa.array(scorer.others(row, column, *summed)), pa.nulls(len(row), pa.float64()) if bm25 is None else pa.array(bm25[row, column])]
            found = pa.RecordBatch.from_arrays([*((mine, theirs) if chunk_side else (theirs, mine)), *values], ["query_id", "cidx", "dense", "bm25"])
            if chunk_side:  # a question is of one batch
                yield found
                continue
            held.append((column, found))
            if sum(len(x) for x, _ in held) > HELD:
                held = [_best_held(held, by, k, places)]
        if held:
            yield _best_held(held, by, k, places)[1]

    return map_arrow(walked, run, f"{shape}, dense double, bm25 double")
