"""Removal of long word spans that an earlier document has, by De Bruijn compaction.

1. Anchors. Of every 26 consecutive 25-word k-mers of a document the least hashed one is an
   anchor, so any 50-word window holds an anchor whole, the same one wherever its words stand.
   Copies of a whole word sequence are represented by their first document.
2. Graph. Anchors that occur in two documents or more are edges of a De Bruijn graph; anchors
   that follow each other are joined where the way neither branches nor merges. Paths are
   compacted by pointer jumping in Spark joins, and the occurrences of a path in a document
   become one span of source coordinates.
3. Verification. Inside the spans, and only there, each 50-word window is hashed from the source,
   to 128 bits from two hashes of words, and the smallest document that holds it is found by a
   combining minimum. Words under a window that a smaller document holds go.

What moves between tasks are hashes and coordinates of repeated spans, and each text once for
its spans and once for its cuts. No group is gathered: hot hashes meet only combining
aggregates and joins that may be split.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..plans.ship import map_arrow
from .common import pair_hash, rolled, steps, written

WINDOW = 50
KMER = 25
#: Ids with several texts up to which they are broadcast.
FEW_IDS = 100_000


def _spread_min(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over each run of ``w`` values, by doubling."""
    span = 1
    while 2 * span <= w:
        x = op(x[:-span], x[span:])
        span *= 2
    return op(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


def anchors(grams: np.ndarray, w: int) -> np.ndarray:
    """Places of the values that are least in some run of ``w``; all of them among equals."""
    least = _spread_min(grams, w, np.minimum)
    pad = np.zeros(w - 1, dtype=grams.dtype)
    return np.flatnonzero(grams == _spread_min(np.concatenate([pad, least, pad]), w, np.maximum))


def _profile(window: int, kmer: int):
    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                n_words, digests, places, marks = [], [], [], []
                for i, j, words in steps(part.column(1)):
                    h = words.hashes()
                    grams = rolled(h, kmer)
                    for d in range(j - i):
                        a, b = words.at[d], words.at[d + 1]
                        n_words.append(int(b - a))
                        if b - a < window:
                            digests.append(None), places.append([]), marks.append([])
                            continue
                        at = anchors(grams[a : b - kmer + 1], window - kmer + 1)
                        digests.append(pair_hash(h[a:b]))
                        places.append(at)
                        marks.append(grams[a + at].view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(2),
                        pa.array(n_words, pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(places, pa.list_(pa.int32())),
                        pa.array(marks, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "version", "n_words", "digest", "places", "marks"],
                )

    return run


def _windows(window: int):
    """(doc_id, text, version, spans) -> the window hashes of each span, as runs from a first place."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                rows, firsts, runs, others = [], [], [], []
                spans = part.column(3)
                for i, j, words in steps(part.column(1)):
                    grams, more = rolled(words.hashes(), window), rolled(words.hashes(other=True), window, other=True)
                    for d in range(j - i):
                        a, n = int(words.at[d]), int(words.at[d + 1] - words.at[d])
                        last = n - window
                        merged: list[list[int]] = []
                        for s in sorted((max(0, x["low"]), min(last, x["high"])) for x in spans[i + d].as_py()):
                            if merged and s[0] <= merged[-1][1] + 1:
                                merged[-1][1] = max(merged[-1][1], s[1])
                            elif s[0] <= s[1]:
                                merged.append(list(s))
                        for s, e in merged:
                            rows.append(i + d)
                            firsts.append(s)
                            runs.append(grams[a + s : a + e + 1].view(np.int64))
                            others.append(more[a + s : a + e + 1].view(np.int64))
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(2).take(at), pa.array(firsts, pa.int32()), pa.array(runs, pa.list_(pa.int64())), pa.array(others, pa.list_(pa.int64()))],
                    ["doc_id", "version", "first", "run", "other"],
                )

    return run


def _paths(steps_: DataFrame, label: str) -> DataFrame:
    """``steps_(mark, following)``, the ways between repeated marks -> ``(mark, head, depth)`` for
    each mark that follows another on a path; marks of a closed ring are left out."""
    ways = steps_.groupBy("mark").agg(F.min("following").alias("x"), F.max("following").alias("y")).where("x = y and x <> mark")
    back = steps_.groupBy("following").agg(F.min("mark").alias("u"), F.max("mark").alias("v")).where("u = v")
    only = ways.join(back, (F.col("mark") == F.col("u")) & (F.col("x") == F.col("following")))
    moving = written(only.select(F.col("following").alias("mark"), F.col("u").alias("head"), F.lit(1).cast("long").alias("depth")), f"{label}-0")
    settled, size, reach, i = moving.limit(0), moving.count(), 1, 0
    while True:
        i += 1
        # one plan at every size: a sort merge, whose hot side may be split
        known = settled.union(moving).select(F.col("mark").alias("head"), F.col("head").alias("top"), F.col("depth").alias("more")).hint("merge")
        step = moving.join(known, "head", "left").select(
            "mark", F.coalesce("top", "head").alias("head"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("top").isNotNull().alias("moved")
        )
        step = written(step, f"{label}-{i}")
        settled = settled.union(step.where("not moved").drop("moved"))
        moving = step.where("moved").drop("moved")
        reach *= 2
        # whoever still moves after that many steps runs in a ring
        if reach > 2 * size or not moving.limit(1).count():
            return settled


def _versioned(rows: DataFrame, twice: DataFrame) -> DataFrame:
    """``rows`` whose version is 0 but where their doc_id has several: a number that moves with every
    anchor should cost nothing. Ids that repeat are few, and broadcast where a count shows it."""
    twice = twice.withColumn("again", F.lit(True))
    few = F.broadcast(twice) if twice.limit(FEW_IDS + 1).count() <= FEW_IDS else twice
    return rows.join(few, "doc_id", "left").withColumn("version", F.when(F.col("again"), F.col("version")).otherwise(F.lit(0))).drop("again")


def repeated_windows(texts: DataFrame, window: int = WINDOW, kmer: int = KMER) -> tuple[DataFrame, DataFrame]:
    """``texts(doc_id, text, version)``, a version being a hash of the text -> (cuts(doc_id, version,
    whole, windows), twice(doc_id)): what goes of a text, all of it for a later copy of a whole word
    sequence, else the first places of the windows that a document of a smaller id has; versions
    are 0 but for the ids of ``twice``, which have several texts."""
    row = ["doc_id", "version"]
    made = map_arrow(texts, _profile(window, kmer), "doc_id long, version long, n_words long, digest binary, places array<int>, marks array<long>")
    made = written(made, "sub-profile")
    twice = made.groupBy("doc_id").agg(F.min("version").alias("x"), F.max("version").alias("y")).where("doc_id is not null and x <> y").select("doc_id")
    twice = written(twice, "sub-twice")
    texts = _versioned(texts, twice)
    some = _versioned(made.where("digest is not null and doc_id is not null"), twice)
    first = written(some.groupBy("digest").agg(F.min("doc_id").alias("rep")), "sub-first")
    copies = some.select(*row, "digest").join(first, "digest").where("doc_id > rep").select(*row).distinct()
    copies = written(copies, "sub-copies")
    alone = some.join(copies, row, "left_anti")
    occurs = alone.select(*row, F.posexplode(F.arrays_zip("places", "marks")).alias("at", "x"))
    occurs = occurs.select(*row, "at", F.col("x.places").alias("place"), F.col("x.marks").alias("mark"))
    often = written(
        occurs.groupBy("mark").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("mark"), "sub-often"
    )
    occurs = written(occurs.join(often, "mark"), "sub-occurs")
    after = occurs.select(*row, (F.col("at") - 1).alias("at"), F.col("mark").alias("following"))
    paths = _paths(occurs.join(after, [*row, "at"]).select("mark", "following"), "sub-paths")
    placed = occurs.join(paths, "mark", "left").select(
        *row, "at", "place", F.coalesce("head", "mark").alias("head"), F.coalesce("depth", F.lit(0)).alias("depth")
    )
    spans = placed.groupBy(*row, "head", (F.col("at") - F.col("depth")).alias("lane")).agg(
        (F.min("place") - (window - kmer)).alias("low"), F.max("place").alias("high")
    )
    spans = written(spans.groupBy(*row).agg(F.collect_list(F.struct("low", "high")).alias("spans")), "sub-spans")
    held = map_arrow(texts.join(spans, row).select("doc_id", "text", "version", "spans"), _windows(window), "doc_id long, version long, first int, run array<long>, other array<long>")
    held = written(held, "sub-windows")
    each = held.select(*row, "first", F.posexplode(F.arrays_zip("run", "other")).alias("i", "h"))
    each = each.select(*row, (F.col("first") + F.col("i")).alias("place"), F.col("h.run").alias("hash"), F.col("h.other").alias("more"))
    owner = each.groupBy("hash", "more").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("y")).where("owner < y").select("hash", "more", "owner")
    owner = written(owner, "sub-owner")  # so that the join has an exchange of its own on either side, which may be split
    gone = each.join(owner, ["hash", "more"]).where("doc_id > owner")
    cut = gone.groupBy(*row).agg(F.collect_list("place").alias("windows")).select(*row, F.lit(False).alias("whole"), "windows")
    whole = copies.select(*row, F.lit(True).alias("whole"), F.array().cast("array<int>").alias("windows"))
    return written(cut.union(whole), "sub-cuts"), twice


def _cut(window: int, keep_text: bool, carry: str | None):
    """(doc_id, row, whole, windows), text in the row -> counts and the words kept, joined by one space."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                counts, removed, digests, kept = [], [], [], []
                given, whole, windows = part.column(1), part.column(2), part.column(3)
                source = given.field("text").cast(pa.string())
                for i, j, words in steps(source):
                    raw = words.data.tobytes()
                    for d in range(j - i):
                        a, b = int(words.at[d]), int(words.at[d + 1])
                        n, at = b - a, windows[i + d].values
                        gone = np.zeros(n + 1, dtype=np.int32)
                        if whole[i + d].as_py():
                            stay = np.zeros(n, dtype=bool) if n >= window else np.ones(n, dtype=bool)
                        elif at is None or not len(at):
                            stay = np.ones(n, dtype=bool)
                        else:
                            at = np.unique(at.to_numpy())
                            gone[at] += 1
                            np.add.at(gone, at + window, -1)
                            stay = np.cumsum(gone[:n]) == 0
                        counts.append(n)
                        removed.append(int(n - stay.sum()))
                        spans = zip(words.starts[a:b][stay].tolist(), words.ends[a:b][stay].tolist())
                        joined = b" ".join([raw[s:e] for s, e in spans])
                        digests.append(hashlib.sha256(joined).hexdigest())
                        if keep_text:
                            kept.append(joined.decode() if removed[-1] else None if carry else source[i + d].as_py())
                out = [part.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if keep_text:
                    out, names = [*out, pa.array(kept, pa.string())], [*names, "kept_text"]
                if carry:
                    out, names = [*out, given], [*names, carry]
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def without_repeats(docs: DataFrame, window: int = WINDOW, kmer: int = KMER, keep_text: bool = True, carry: str | None = None) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> doc_id, n_words, n_removed, kept_sha256 (, kept_text) (, the
    row of ``docs`` as a struct named ``carry``).

    A word goes when it lies in ``window`` consecutive words that also stand in a document with a
    smaller doc_id; all windows are judged on the input. kept_sha256 is of the kept words joined
    by one space. kept_text is that string, or the text as it was where nothing goes (null stays
    null); with ``carry`` it is null there, for the row holds the text. Null, blank and short texts have no window and lose nothing. Repeats inside one
    document, or among rows of one doc_id, are no reason; rows of one doc_id with different texts
    are cut each by itself; rows without a doc_id lose nothing. Other columns are ignored, or only
    carried along; an empty table gives an empty result.
    """
    text = F.col("text").cast("string")
    given = docs.select(F.struct(*(docs.columns if carry else ["text"])).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("version"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("version"))
    cuts, twice = repeated_windows(texts, window, kmer)
    fields = [StructField("doc_id", LongType()), StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_sha256", StringType())]
    fields += [StructField("kept_text", StringType())] * keep_text + ([StructField(carry, given.schema["row"].dataType)] if carry else [])
    joined = _versioned(given, twice).join(cuts, ["doc_id", "version"], "left").select("doc_id", "row", "whole", "windows")
    return map_arrow(joined, _cut(window, keep_text, carry), StructType(fields))
