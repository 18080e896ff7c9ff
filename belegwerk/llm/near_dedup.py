"""MinHash near-duplicate detection with circulant signatures.

Signatures: a first permutation sends each shingle hash to a place on a ring of RING cells, a
second one numbers the cells; coordinate k is the least number among the cells k steps on. So
one table of cell numbers, read at consecutive cells, gives all coordinates of a shingle.
Bands of ROWS coordinates make BANDS candidate keys: a pair at similarity 0.8 shares no key
with probability (1 - 0.8**8)**64 < 1e-5. Sets of over DENSE shingles would fill the ring, so
they are thinned by hash to a level of their size, and carry the keys of the next level too
where a partner may be large enough to be thinned to it.

Links are confirmed on full shingle sets, in two steps. Copies collapse first to one
representative by the digest of their sets.

1. A key offers its members its most connected one as a centre, and each document is compared
   with the one centre that it shares most keys with: a comparison for each document.
2. Pairs that share a key and are still in different components remain. Their documents are
   described by their difference from a pivot, the most connected document of the component
   they were compared with. Of documents with one pivot, |A xor B| is at least the sum of the
   differences less twice the smaller number of those shingles in a difference that no other
   document's has; where that exceeds what the threshold allows, the pair is no link. Only pairs
   that this exact bound, or their sizes, do not rule out are compared, each once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ship import map_arrow
from .common import LOWER, chained, mix, pair_hash, steps, written
from .components import components

RING = 1 << 20
BANDS, ROWS = 64, 8
COORDINATES = BANDS * ROWS
#: Shingles of a set from which on it is thinned for its signature.
DENSE = 1 << 16
_SIGMA = np.uint64(0xA0761D6478BD642F)
_THIN = np.uint64(0xE7037ED1A0B428DB)
_CELLS = None


def _cells() -> np.ndarray:
    """cells[i]: the numbers of the COORDINATES cells from i on, as a view."""
    global _CELLS
    if _CELLS is None:
        ring = np.random.default_rng(20).permutation(RING).astype(np.uint32)
        _CELLS = np.lib.stride_tricks.sliding_window_view(np.concatenate([ring, ring[:COORDINATES]]), COORDINATES)
    return _CELLS


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text, in order."""
    for i, j, words in steps(texts):
        h = words.hashes(LOWER)
        grams = chained(h, k)
        for d in range(j - i):
            a, b = words.at[d], words.at[d + 1]
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield chained(h[a:b], int(b - a))
            else:
                yield h[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """COORDINATES minima of a non-empty set."""
    cells = _cells()
    at = (mix(shingles ^ _SIGMA) % np.uint64(RING)).astype(np.int64)
    low = None
    for i in range(0, len(at), 256):
        part = cells[at[i : i + 256]].min(axis=0)
        low = part if low is None else np.minimum(low, part)
    return low


def _levels(n: int, percent: int) -> list[int]:
    """Levels of thinning of a set of ``n``: its own, and that of its largest possible partner."""
    return sorted({max(0, (m // DENSE).bit_length()) for m in (n, n * 100 // max(percent, 1))})


def band_keys(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The candidate keys of a non-empty set."""
    salt = (np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    band_salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    keys = []
    for level in _levels(len(shingles), percent):
        some = shingles[mix(shingles ^ _THIN) >> np.uint64(64 - level) == 0] if level else shingles
        if len(some):
            sig = signature(some).astype(np.uint64)
            keys.append(mix((mix(sig.reshape(BANDS, ROWS) + salt) * salt).sum(axis=1, dtype=np.uint64) + band_salt + np.uint64(level)))
    return np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)


def _profile(k: int, percent: int):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                sizes, digests, keys = [], [], []
                for s in shingle_sets(part.column(1), k):
                    sizes.append(len(s))
                    digests.append(pair_hash(s) if len(s) else None)
                    keys.append(band_keys(s, percent) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "n_shingles", "digest", "bands"],
                )

    return run


def _sets(k: int):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1), k)], pa.binary())], ["id", "shingles"]
                )

    return run


def _confirmed(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (a, b))
                both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _deltas(batches):
    """(id, pivot, x, y) -> id, pivot, sizes and the shingles in just one of the two sets."""
    for batch in batches:
        n, apart, deltas = [], [], []
        for a, b in zip(batch.column(2), batch.column(3)):
            x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (a, b))
            d = np.setxor1d(x, y, assume_unique=True)
            n.append(len(x)), apart.append(len(d)), deltas.append(d.tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(apart, pa.int64()), pa.array(deltas, pa.binary())],
            ["id", "pivot", "n", "apart", "delta"],
        )


def _holders(batches):
    """(id, pivot, delta) -> for each pivot and shingle of a task the least and the largest id
    whose difference has it; combined here before anything is shuffled."""
    for batch in batches:
        ids, pivots = (batch.column(i).to_numpy() for i in (0, 1))
        parts = [np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in batch.column(2)]
        sizes = [len(p) for p in parts]
        shingle = np.concatenate([np.zeros(0, np.uint64), *parts])
        who, of = np.repeat(ids, sizes), np.repeat(pivots, sizes)
        order = np.lexsort((who, shingle, of))
        who, of, shingle = who[order], of[order], shingle[order]
        first = np.ones(len(who), dtype=bool)
        first[1:] = (of[1:] != of[:-1]) | (shingle[1:] != shingle[:-1])
        last = np.append(first[1:], True)[: len(first)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(of[first]), pa.array(shingle[first].view(np.int64)), pa.array(who[first]), pa.array(who[last])], ["pivot", "shingle", "low", "high"]
        )


def _beside(rows: DataFrame, sets: DataFrame, left: str, right: str) -> DataFrame:
    """``rows`` with the sets of two of their ids, x and y. The joins are sort merges at every
    size, so that the plan of a small table is that of a large one, and hot ids may be split."""
    return (
        rows.hint("merge")
        .join(sets.select(F.col("id").alias(right), F.col("shingles").alias("y")), right)
        .join(sets.select(F.col("id").alias(left), F.col("shingles").alias("x")).hint("merge"), left)
        .select(left, right, "x", "y")
    )


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    return map_arrow(_beside(pairs.select("a", "b"), sets, "a", "b"), _confirmed(percent), "a long, b long")


def _undecided(open_: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), a < b, of ``open_(key, id)`` that share a key and that neither components nor
    sizes nor the bound on differences decide; each at the least key that they share.

    ``facts(id, component, pivot, n, apart, own)``: own shingles of a difference are in no other
    one with that pivot. A link has |A xor B| <= (100 - p) / (100 + p) * (|A| + |B|), and shares at
    most apart - own shingles of either difference.
    """
    keys = open_.groupBy("id").agg(F.collect_set("key").alias("keys"))
    rows = written(open_.join(facts, "id").join(keys, "id"), "near-open")
    l, r = rows.alias("l"), rows.alias("r")
    c = lambda side, name: F.col(f"{side}.{name}")
    size = F.least(c("l", "n"), c("r", "n")) * 100 >= F.greatest(c("l", "n"), c("r", "n")) * percent
    shared = F.least(c("l", "apart") - c("l", "own"), c("r", "apart") - c("r", "own"))
    bound = (100 + percent) * (c("l", "apart") + c("r", "apart") - 2 * shared) <= (100 - percent) * (c("l", "n") + c("r", "n"))
    once = F.array_min(F.array_intersect(c("l", "keys"), c("r", "keys"))) == c("l", "key")
    may = (c("l", "id") < c("r", "id")) & (c("l", "component") != c("r", "component")) & size & ((c("l", "pivot") != c("r", "pivot")) | bound)
    return l.join(r, (c("l", "key") == c("r", "key")) & may & once).select(c("l", "id").alias("a"), c("r", "id").alias("b"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> ``(doc_id, n_shingles, component_id, kept)``.

    Two documents are linked where 100 * |A and B| >= percent * |A or B| over their sets of
    k-word shingles (A-Z lower-cased; fewer words than k: the whole sequence is one shingle).
    component_id is the smallest doc_id reachable over links. Null, empty and blank texts link
    with nothing and keep their own id. A null doc_id is a document of its own with a null
    component. Rows that repeat a doc_id are one document with several texts: each links, and all take
    the smallest component. Other columns of any name are ignored. An empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    made = written(map_arrow(texts, _profile(k, percent), "doc_id long, n_shingles long, digest binary, bands array<long>"), "near-profile")
    some = made.where("digest is not null and doc_id is not null")
    # aggregates that are joined back are written first: the join then has an exchange of its own
    # on either side, and hot keys may be split
    classes = written(some.groupBy("digest").agg(F.min("doc_id").alias("rep")), "near-classes")
    member = written(some.select("doc_id", "digest").join(classes, "digest").select("doc_id", "rep").distinct(), "near-members")
    reps = some.join(member.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "bands")
    keyed = reps.select(F.explode("bands").alias("key"), "id").distinct()
    hot = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high"))
    hot = written(hot.where("low < high").select("key", "n"), "near-hot")
    keyed = written(keyed.join(hot, "key"), "near-keys")
    # a key's centre is its member that meets most others over all keys: the source of a group of
    # copies, which are closer to it than to each other
    degrees = written(keyed.groupBy("id").agg(F.sum("n").alias("degree")), "near-degrees")
    centres = keyed.join(degrees, "id").groupBy("key").agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("centre"))
    centres = written(centres, "near-centres")
    centred = keyed.join(centres, "key").where("id <> centre")
    stars = centred.groupBy(F.col("centre").alias("a"), F.col("id").alias("b")).count()
    pairs = written(stars.groupBy("b").agg(F.max_by("a", F.struct("count", -F.col("a"))).alias("a")).select("a", "b"), "near-pairs")
    # a set is made once for each document that shares a key, and read by id from then on
    sets = map_arrow(texts.join(degrees.select("id").hint("merge"), "id", "left_semi").select("id", "text"), _sets(k), "id long, shingles binary")
    sets = written(sets, "near-sets")
    links = written(_links(pairs, sets, percent), "near-links")
    labels = components(links, "near-first")

    named = keyed.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    named = written(named, "near-named")
    mixed = named.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("key")
    open_ = written(named.join(written(mixed, "near-mixed"), "key"), "near-mixed-rows")
    if open_.limit(1).count():
        tops = labels.join(degrees, "id").groupBy("component").agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("top"))
        of = pairs.join(labels.withColumnRenamed("id", "a"), "a", "left").select(F.col("b").alias("id"), F.coalesce("component", "a").alias("of"))
        whose = open_.select("id", "component").distinct().join(of, "id", "left").withColumn("of", F.coalesce("of", "component"))
        whose = whose.join(tops.withColumnRenamed("component", "of"), "of", "left").select("id", "component", F.coalesce("top", "of").alias("pivot"))
        # an id with several texts has no one difference: it and those beside it go without the bound
        twice = written(sets.groupBy("id").count().where("count > 1").select("id"), "near-twice")
        whose = whose.join(twice.select(F.col("id").alias("pivot"), F.lit(True).alias("x")), "pivot", "left").join(twice.withColumn("y", F.lit(True)), "id", "left")
        whose = whose.select("id", "component", F.when(F.col("x").isNotNull() | F.col("y").isNotNull(), F.col("id")).otherwise(F.col("pivot")).alias("pivot"))
        whose = written(whose, "near-whose")
        apart = map_arrow(_beside(whose.select("id", "pivot"), sets, "id", "pivot"), _deltas, "id long, pivot long, n long, apart long, delta binary")
        apart = written(apart, "near-apart")
        held = map_arrow(apart.select("id", "pivot", "delta"), _holders, "pivot long, shingle long, low long, high long")
        held = held.groupBy("pivot", "shingle").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low = high")
        own = written(held.groupBy(F.col("low").alias("id")).agg(F.count("*").alias("own")), "near-own")
        facts = whose.join(apart.select("id", "n", "apart"), "id").join(own, "id", "left").withColumn("own", F.coalesce("own", F.lit(0)))
        rest = _undecided(open_.select("key", "id"), written(facts, "near-facts"), percent)
        tried = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        rest = written(rest.join(tried, ["a", "b"], "left_anti").distinct(), "near-rest")
        old = labels.select(F.col("id").alias("a"), F.col("component").alias("b"))
        labels = components(old.union(_links(rest, sets, percent)), "near-second")
    of = member.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    of = of.groupBy("doc_id").agg(F.min("component").alias("component"))
    return (
        made.select("doc_id", "n_shingles")
        .join(of, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
