"""Winnowed fingerprints, by SQL expressions alone.

A text's k-grams are all runs of GRAM characters of its words joined by one blank. In every WINDOW
consecutive k-grams the one of least hash is kept with its place, the rightmost of equals; so texts that share GRAM + WINDOW - 1 characters in a row share a kept hash, with white
space or without. Texts under 6 * WINDOW characters have windows of a sixth of their length, and
those of which two thirds are no k-gram have grams of 2. What a wide window keeps the narrow ones
inside it keep too, so texts of different length stay comparable.

Order is by the high 32 bits of a hash; the low half of the number compared is the place, so a
plain minimum picks the rightmost of the least. What is kept is the whole 64-bit hash, and the
place beside it.

Each k-gram is hashed by itself. Hashes that roll, each made of the one before it by a shift and
an xor, have no form in SQL expressions but passes over the whole array, which take twice the time.

Each text is hashed and winnowed once. The edited text consists of a part of a text and a part
of the next one, and a window inside either part keeps what it kept there, so only the windows
over the seam and the cut end are winnowed anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality_rules import SPACES

GRAM, WINDOW = 5, 12
_LAST = (1 << 31) - 1
#: Blocks of doc_ids for each shuffle partition.
SPREAD = 4


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def line_of(text: Column) -> Column:
    """The words of a text joined by one blank. Only runs that differ from a blank are replaced."""
    return F.trim(F.regexp_replace(text, "[\t-\r][ \t-\r]*+| [ \t-\r]++", " "))


def _grams(line: Column, k: int) -> Column:
    """All runs of ``k`` code points, in order."""
    return F.regexp_extract_all(line, F.lit("(?s)(?=(.{%d}))." % k), F.lit(1))


def _minima(v: Column, window: int) -> Column:
    """The least of every ``window`` consecutive numbers, of ``window`` at least, by doubling."""

    def wider(m: Column, width: int) -> Column:
        if width == window:
            return F.slice(m, 1, F.size(m) - window + 1)
        by = min(width, window - width)
        return _let(F.zip_with(m, F.slice(m, by + 1, F.size(m)), lambda a, b: F.least(a, b)), lambda x: wider(x, width + by))

    return wider(v, 1)


def _narrow(v: Column, width: Column) -> Column:
    """As ``_minima``, for a width by row; of fewer numbers than that, the least of all."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(v) - width + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.array_min(F.slice(v, i, width)))


def _none() -> Column:
    return F.struct(F.array().cast("array<bigint>").alias("h"), F.array().cast("array<int>").alias("p"))


def _winnowed(grams: Column, minima) -> Column:
    """(h, p): the hashes that winnowing keeps and their places, in order of place."""

    def numbered(g: Column) -> Column:
        return F.transform(g, lambda x, i: F.xxhash64(x).bitwiseAND(F.lit(-1 << 32)).bitwiseOR((F.lit(_LAST) - i).cast("long")))

    def kept(g: Column) -> Column:
        least = F.array_distinct(_let(numbered(g), minima))
        places = F.transform(least, lambda v: F.lit(_LAST) - v.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
        return _let(places, lambda p: F.struct(F.transform(p, lambda i: F.xxhash64(F.element_at(g, i + 1))).alias("h"), p.alias("p")))

    return _let(grams, kept)


def _wide_kept(line: Column, gram: int, window: int) -> Column:
    """What full windows keep; nothing in a text that has none."""
    return F.when(F.length(line) >= gram + window - 1, _winnowed(_grams(line, gram), lambda v: _minima(v, window))).otherwise(_none())


def _is_wide(n: Column, gram: int, window: int) -> Column:
    return (n >= 6 * window) & (n >= gram + window - 1)


def _narrow_kept(line: Column, gram: int, window: int) -> Column:
    """What a text too short for full windows keeps; null where it has them."""
    n = F.length(line)
    width = F.least(F.greatest(F.floor(n / 6).cast("int"), F.lit(1)), F.lit(window))

    grams = F.when(n - F.floor(n / 3) >= gram, _grams(line, gram)).when(n >= 2, _grams(line, min(gram, 2))).otherwise(F.array(line))
    made = _winnowed(grams, lambda v: _narrow(v, width))
    return F.when(n == 0, _none()).when(~_is_wide(n, gram, window), made)


def shown(kept: Column) -> Column:
    """``hash@place`` of each kept k-gram, places from 0."""
    return F.array_join(F.zip_with(kept["h"], kept["p"], lambda h, p: F.concat(F.hex(h), F.lit("@"), p.cast("string"))), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of hashes; two empty ones are alike."""
    all_ = F.size(F.array_union(a, b))
    return F.when(all_ == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / all_).cast("double")


def _edited_kept(gram: int, window: int) -> Column:
    """What full windows keep of the edited line ``a || gap || b``, of what they keep of the lines
    that a and b begin (``wide``, ``next.wide``) and of the windows over the seam and the end. The
    lengths (``a_n``, ``gap_n``, ``b_n``) and what the windows over the seam and the end keep
    (``seam``, ``tail``) are columns of their own: a lambda computes what stands in it for each
    element."""
    span = gram + window - 2
    a_n, b_n, zero = F.col("a_n"), F.col("b_n"), F.col("a_n") + F.col("gap_n")
    # the last starts of windows that lie inside a and inside b
    in_a, in_b = a_n - span - 1, b_n - span - 1
    front = lambda kept, last: _let(F.size(F.filter(kept["p"], lambda p: p <= last)), lambda n: F.struct(F.slice(kept["h"], 1, n).alias("h"), F.slice(kept["p"], 1, n).alias("p")))

    def moved(kept: Column, by: Column, least: Column) -> Column:
        """Pairs (p, h) with places moved by ``by``, those beyond ``least``."""
        return F.filter(F.zip_with(kept["h"], kept["p"], lambda h, p: F.struct((p + by).alias("p"), h.alias("h"))), lambda x: x["p"] > least)

    def joined(of_a: Column, of_b: Column, few: Column) -> Column:
        # up to window - 2 places into b, windows over the seam add to those of b
        near = F.struct(F.slice(of_b["h"], 1, few).alias("h"), F.slice(of_b["p"], 1, few).alias("p"))
        over = moved(F.col("seam"), a_n - F.least(a_n, F.lit(span + window)), in_a)
        last = moved(F.col("tail"), zero + b_n - F.least(b_n, F.lit(span + window)), zero + in_b)
        some = F.array_sort(F.array_distinct(F.concat(over, moved(near, zero, F.lit(-1)), last)))
        rest = F.size(of_b["p"]) - few
        tops, places = F.slice(of_b["h"], few + 1, rest), F.transform(F.slice(of_b["p"], few + 1, rest), lambda p: p + zero)

        def whole(s: Column) -> Column:
            low, high = F.filter(s, lambda x: x["p"] <= zero + window - 2), F.filter(s, lambda x: x["p"] > zero + window - 2)
            return F.struct(
                F.concat(of_a["h"], F.transform(low, lambda x: x["h"]), tops, F.transform(high, lambda x: x["h"])).alias("h"),
                F.concat(of_a["p"], F.transform(low, lambda x: x["p"]), places, F.transform(high, lambda x: x["p"])).alias("p"),
            )

        return _let(some, whole)

    of_few = lambda of_b: F.size(F.filter(F.slice(of_b["p"], 1, window), lambda p: p <= window - 2))
    return _let(front(F.col("wide"), in_a), lambda of_a: _let(front(F.col("next.wide"), in_b), lambda of_b: _let(of_few(of_b), lambda few: joined(of_a, of_b, few))))


def _numbers(values) -> Column:
    """A constant array of longs."""
    values = list(values)
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>") if values else F.array().cast("array<long>")


def _block(splits: list[int]) -> Column:
    """The number of splits below doc_id, in two steps of about the root of their number."""
    if not splits:
        return F.lit(0)
    step = max(1, int(len(splits) ** 0.5))
    below = lambda values: F.size(F.filter(values, lambda s: s < F.col("doc_id")))
    coarse = below(_numbers(splits[::step]))
    fine = _let(coarse, lambda i: F.when(i == 0, 0).otherwise((i - 1) * step + below(F.slice(_numbers(splits), (i - 1) * step + 1, step))))
    return fine.cast("int")


def _dealt(texts: DataFrame) -> DataFrame:
    """The rows in blocks of neighbouring doc_ids, ``(block, guest, doc_id, text)``. The rows of a
    block's largest id are guests in the block above too, those of the largest of all in the
    lowest. One exchange, whose partitions are as many as they are, for what follows is much work on
    few bytes; of all ids only some quantiles and each block's largest are collected."""
    parts = max(1, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = SPREAD * parts
    cuts = texts.agg(F.percentile_approx("doc_id", [i / blocks for i in range(1, blocks)] or [0.5], F.lit(100 * blocks))).first()[0]
    placed = texts.withColumn("block", _block(sorted(set(cuts or []))))
    tops = sorted((r[0], r[1]) for r in placed.groupBy("block").agg(F.max("doc_id")).collect())
    size = tops[-1][0] + 1 if tops else 1
    top, above = [0] * size, [0] * size
    for i, (b, high) in enumerate(tops):
        top[b], above[b] = high, tops[(i + 1) % len(tops)][0]
    at = lambda block, guest: F.struct(block.cast("int").alias("block"), F.lit(guest).alias("guest"))
    own = F.col("block")
    places = F.when(
        F.col("doc_id") == F.element_at(_numbers(top), own + 1), F.array(at(own, False), at(F.element_at(_numbers(above), own + 1), True))
    ).otherwise(F.array(at(own, False)))
    return placed.select("doc_id", "text", F.explode(places).alias("at")).select("at.block", "at.guest", "doc_id", "text").repartition(parts, "block")


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The edited text has its last third replaced by the start of the next document's text, in
    descending order of doc_id, the first after the last. near_edited and near_next are the
    likeness of the fingerprint to the edited text's and to the next document's. Null texts are
    empty; a text without words has the empty fingerprint, alike with its kind. Of rows that
    repeat a doc_id each is fingerprinted, and the one with the least text stands as the next
    document. Rows without a doc_id have no next one: the third is cut off and near_next is 0.
    Other columns are ignored; an empty table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def kept(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("line", line_of(F.col("text")))
        return rows.withColumns({"wide": _wide_kept(F.col("line"), gram, window), "narrow": _narrow_kept(F.col("line"), gram, window)}).drop("line")

    order = Window.partitionBy("block").orderBy(F.col("guest").desc(), "doc_id", F.col("text").desc())
    rows = kept(_dealt(texts.where("doc_id is not null")))
    rows = rows.withColumn("next", F.lag(F.struct("guest", "doc_id", "text", "wide", "narrow")).over(order))
    # rows of one doc_id all follow the last row before them
    other = F.when(F.col("next.guest") | (F.col("next.doc_id") != F.col("doc_id")), F.col("next"))
    rows = rows.withColumn("next", F.last(other, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    full = rows.where("not guest").select("doc_id", "text", "wide", "narrow", "next")
    alone = kept(texts.where("doc_id is null")).withColumn("next", F.lit(None).cast(rows.schema["next"].dataType))
    full = full.unionByName(alone)

    full = full.withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    full = full.withColumn("a", F.left("text", F.col("n_chars").cast("int") - third)).withColumn("b", F.coalesce(F.left("next.text", third), F.lit("")))
    full = full.withColumn("edited_sha256", F.sha2(F.concat("a", "b"), 256))
    blank = F.right("a", F.lit(1)).isin(*SPACES) | F.left("b", F.lit(1)).isin(*SPACES)
    full = full.withColumns({"a": line_of(F.col("a")), "b": line_of(F.col("b")), "gap": blank})
    full = full.withColumn("gap", F.when(F.col("gap") & (F.col("a") != "") & (F.col("b") != ""), " ").otherwise(""))
    full = full.withColumns({f"{c}_n": F.length(c) for c in ("a", "gap", "b")})
    span = gram + window - 2
    seam = F.concat(F.right("a", F.lit(span + window)), F.col("gap"), F.left("b", F.lit(span)))
    full = full.withColumns({"seam": seam, "tail": F.right("b", F.lit(span + window))})
    full = full.withColumns({c: _wide_kept(F.col(c), gram, window) for c in ("seam", "tail")})
    edited = F.concat("a", "gap", "b")
    full = full.withColumn("ek", F.when(_is_wide(F.col("a_n") + F.col("gap_n") + F.col("b_n"), gram, window), _edited_kept(gram, window)).otherwise(_narrow_kept(edited, gram, window)))
    full = full.select("doc_id", "n_chars", "edited_sha256", F.coalesce("narrow", "wide").alias("k"), "ek", F.coalesce("next.narrow.h", "next.wide.h").alias("next_hashes"))
    return full.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        shown(F.col("k")).alias("fingerprint"),
        shown(F.col("ek")).alias("edited_fingerprint"),
        likeness(F.col("k.h"), F.col("ek.h")).alias("near_edited"),
        F.coalesce(likeness(F.col("k.h"), F.col("next_hashes")), F.lit(0.0)).alias("near_next"),
    )
