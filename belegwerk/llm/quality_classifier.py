"""Text quality by random-indexing word vectors and a small network.

Random indexing: every word has a fixed sparse ternary index vector, found by hash. A word's
context vector is the sum of the index vectors of the words up to REACH places before and after it,
gathered over a bounded sample of labelled documents into BUCKETS hashed rows, so that the table's
size does not depend on the corpus: words of one row share a vector, and a word that the sample
lacks has none, or that of what shares its row. A document is the mean of its words' context
vectors, the mean index vector of their shapes (letters by case, digits, marks), which words
outside the sample have too, and the mean likeness of neighbouring words' index vectors. Two
layers of weights, trained in numpy on the driver from the same sample, give a score, whose
temperature is fitted on a part of the sample left out of training.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ship import map_arrow
from .common import LOWER, least_hashed, mix, steps, written

BUCKETS, DIM, NONZERO, REACH = 1 << 15, 48, 6, 2
#: At most this many labelled documents train the vectors and the network.
SAMPLE = 6_000
HIDDEN, CUT = 24, 0.3
_U = np.uint64
_SHAPE = np.full(256, ord("a"), dtype=np.uint8)
_SHAPE[:128] = np.arange(128)
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[ord("0") : ord("9") + 1] = ord("0")
_SHAPE[0xC3] = ord("a")


def index_vectors(n: int = BUCKETS, dim: int = DIM, seed: int = 7) -> np.ndarray:
    """A sparse ternary vector for each bucket."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, dim), dtype=np.float32)
    at = np.argpartition(rng.random((n, dim)), NONZERO, axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.array([-1.0, 1.0], dtype=np.float32), (n, NONZERO)), axis=1)
    return out


def _bucket(h: np.ndarray) -> np.ndarray:
    return (mix(h) >> _U(32)).astype(np.int64) % BUCKETS


def _keys(words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of their shapes."""
    return _bucket(words.hashes(LOWER)), _bucket(words.hashes(_SHAPE))


def _contexts(batches):
    """One row for each task: the sums of neighbours' index vectors by word bucket."""
    index, table = index_vectors(), np.zeros((BUCKETS, DIM), dtype=np.float64)
    seen = np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        for i, j, words in steps(batch.column(0)):
            w, _ = _keys(words)
            of = np.repeat(np.arange(j - i), np.diff(words.at))
            around = np.zeros((len(w), DIM), dtype=np.float32)
            for d in range(1, REACH + 1):
                near = of[d:] == of[:-d]  # neighbours in one document
                around[d:][near] += index[w[:-d][near]]
                around[:-d][near] += index[w[d:][near]]
            order = np.argsort(w, kind="stable")
            firsts = np.flatnonzero(np.diff(w[order], prepend=-1))
            if len(firsts):
                table[w[order][firsts]] += np.add.reduceat(around[order], firsts, axis=0)
                seen += np.bincount(w, minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array([table.astype(np.float32).tobytes()], pa.binary()), pa.array([seen.tobytes()], pa.binary())], ["vectors", "seen"])


def pooled(words, contexts: np.ndarray, index: np.ndarray) -> np.ndarray:
    """A row for each document: mean context vector, mean shape vector, mean likeness of a word's
    index vector to the next one's (1 for the same word), log of the word count."""
    n = len(words.at) - 1
    out = np.zeros((n, 2 * DIM + 2), dtype=np.float32)
    w, s = _keys(words)
    counts = np.diff(words.at)
    full = np.flatnonzero(counts)
    for lo in range(0, len(full), 256):
        some = full[lo : lo + 256]
        a, b = words.at[some[0]], words.at[some[-1] + 1]
        at = words.at[some] - a
        out[some, :DIM] = np.add.reduceat(contexts[w[a:b]], at, axis=0) / counts[some, None]
        out[some, DIM : 2 * DIM] = np.add.reduceat(index[s[a:b]], at, axis=0) / counts[some, None]
        like = np.append(np.einsum("ij,ij->i", index[w[a : b - 1]], index[w[a + 1 : b]]) / NONZERO, 0)
        like[np.append(at[1:], b - a) - 1] = 0  # the next word is another document's
        out[some, -2] = np.add.reduceat(like, at) / counts[some]
    out[:, -1] = np.log1p(counts)
    return out


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, epochs: int = 60, rate: float = 0.01, decay: float = 1e-3, seed: int = 3) -> Network:
    """Adam on the logistic loss, rows in another order each epoch; a fifth of the rows fits the
    temperature. With one class, or without rows, the score is constant."""
    rng, dim = np.random.default_rng(seed), x.shape[1]
    if not len(y) or y.min() == y.max():
        zeros = np.zeros
        return Network(zeros(dim), np.ones(dim), zeros((dim, HIDDEN)), zeros(HIDDEN), zeros(HIDDEN), 0.0 if not len(y) else float(8 * y[0] - 4))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    if len(set(y[used])) < 2:
        used = order
    z = np.clip((x - mean) / scale, -8, 8)
    params = [rng.normal(0, 1 / np.sqrt(dim), (dim, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.2, HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        shuffled = rng.permutation(used)
        for lo in range(0, len(used), 128):
            i = shuffled[lo : lo + 128]
            hidden = np.tanh(z[i] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -40, 40)))
            e = (p - y[i]) / len(i)
            back = e[:, None] * params[2] * (1 - hidden**2)
            grads = [z[i].T @ back + decay * params[0], back.sum(axis=0), hidden.T @ e + decay * params[2], np.array([e.sum()])]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                params[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net = Network(mean, scale, params[0], params[1], params[2], float(params[3][0]))
    if len(held) and len(set(y[held])) > 1:
        raw = net.logits(x[held])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.mean(np.logaddexp(0, -np.where(y[held] == 1, raw, -raw) / g)) for g in grid]
        net.temperature = float(grid[int(np.argmin(loss))])
    return net


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``docs(doc_id, text, ...)``, ``labels(doc_id, quality, ...)`` -> doc_id, held_out, score,
    predicted.

    Labels are learned from rows whose crc32(doc_id as text) mod 5 is not 0, of these from the
    ``sample`` ones of least hash. score is the calibrated probability of label 1, from the text
    alone; null and empty texts have one too. predicted is 1 from CUT on. held_out marks the
    rows that no label is learned from; a null doc_id is held out. Repeated rows are scored each;
    labels of null or conflicting repeated ids train as they come; other columns are ignored; an
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.where("doc_id is not null and quality is not null").where(fold != 0).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y"))
    known = least_hashed(known.withColumn("h", F.xxhash64("doc_id")), sample, "doc_id")
    chosen = spark.createDataFrame([(r["doc_id"], r["y"]) for r in known.collect()], "doc_id long, y double")  # at most ``sample`` rows
    # every document is scanned once for the sample, in as many tasks as there are; the few rows are written
    learned = written(texts.join(F.broadcast(chosen), "doc_id"), "quality-sample")

    parts = map_arrow(learned.select("text").coalesce(2), _contexts, "vectors binary, seen binary").collect()  # one fixed-size table for each of at most 2 tasks
    table, seen = np.zeros((BUCKETS, DIM)), np.zeros(BUCKETS, dtype=np.int64)
    for r in parts:
        table += np.frombuffer(r["vectors"], dtype=np.float32).reshape(BUCKETS, DIM)
        seen += np.frombuffer(r["seen"], dtype=np.int64)
    index = index_vectors()
    table = np.where(seen[:, None] > 0, table / np.maximum(seen, 1)[:, None], 0)
    contexts = table.astype(np.float32)
    shared = spark.sparkContext.broadcast((contexts, index))

    def gathered(batches):
        for batch in batches:
            for i, j, words in steps(batch.column(1)):
                rows = pooled(words, *shared.value)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([x.tobytes() for x in rows], pa.binary())], ["y", "x"])

    rows = map_arrow(learned.select("y", "text"), gathered, "y double, x binary").collect()  # at most the labelled sample, some 400 bytes each
    rows = sorted((r["x"], r["y"]) for r in rows)
    x = np.array([np.frombuffer(bytes(r[0]), dtype=np.float32) for r in rows], dtype=np.float64).reshape(len(rows), 2 * DIM + 2)
    net = train(x, np.array([r[1] for r in rows]))
    final = spark.sparkContext.broadcast(net)

    def scored(batches):
        for batch in batches:
            for i, j, words in steps(batch.column(1)):
                s = final.value.score(pooled(words, *shared.value).astype(np.float64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(s, pa.float64())], ["doc_id", "score"])

    out = map_arrow(texts, scored, "doc_id long, score double")
    return out.select(
        "doc_id", (F.coalesce(fold, F.lit(0)) == 0).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted")
    )
