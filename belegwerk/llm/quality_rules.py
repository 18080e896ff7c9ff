"""Quality rules: a threshold table compiled into one projection of SQL expressions.

Everything is computed row by row inside the JVM, so the plan has no shuffle and no Python,
and a long or hot document costs only itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = "\t\n\x0b\x0c\r "
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the languages served, as fixed values.
STOP_WORDS = (
    "the of and to in is that for it as with was by on are be this "
    "der die das und von zu den mit im ist nicht "
    "le la les de des et en un une du que pour dans est au par sur "
    "el los las del y con se una su al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie in [least, most]; documents under ``from_words`` words are exempt."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    from_words: int = 0


#: The threshold table. Measures are columns of ``measures``.
RULES = (
    Rule("word_length", "mean_word_chars", 1.5, 14.0),
    Rule("symbols", "symbols_per_word", most=0.3),
    Rule("dup_lines", "dup_line_share", most=0.3),
    Rule("stop_words", "stop_word_share", least=0.04, from_words=30),
    Rule("upper_case", "upper_share", most=0.5, from_words=10),
    Rule("marks", "mark_share", most=0.3, from_words=10),
)


def _count_of(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def words_of(text: Column) -> Column:
    """The words of a text, as an array. One-character split, so no regular expression runs."""
    plain = F.translate(text, SPACES, " " * len(SPACES))
    return F.array_remove(F.split(plain, " "), "")


def _repeat_words(words: Column, n: Column, k: int = 5) -> Column:
    """Words in k-word windows that occur twice or more. Most texts have no such window, which a
    set of window hashes shows; only the others sort (hash, place) pairs to mark the repeats."""
    starts = F.sequence(F.lit(1), n - k + 1)
    grams = F.transform(starts, lambda i: F.xxhash64(F.slice(words, i, k)))

    def repeated(g: Column) -> Column:
        placed = F.sort_array(F.zip_with(g, F.sequence(F.lit(1), F.size(g)), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        after = F.slice(placed, 2, F.size(placed))
        before = F.concat(F.array(F.lit(None).cast(placed_type)), placed)
        around = F.arrays_zip(placed.alias("p"), F.concat(after, F.array(F.lit(None).cast(placed_type))).alias("a"), F.slice(before, 1, F.size(placed)).alias("b"))
        return F.transform(
            F.filter(around, lambda x: x["p"]["h"].eqNullSafe(x["a"]["h"]) | x["p"]["h"].eqNullSafe(x["b"]["h"])), lambda x: x["p"]["i"]
        )

    placed_type = "struct<h:bigint,i:int>"

    def covered(at: Column) -> Column:
        gaps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.when(b.isNull(), k).otherwise(F.least(F.lit(k), b - a)))
        return F.aggregate(gaps, F.lit(0), lambda s, x: s + x)

    # let-bindings by one-element arrays: each value is computed once
    bound = F.transform(
        F.array(grams),
        lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(
            F.element_at(F.transform(F.array(F.sort_array(repeated(g))), covered), 1)
        ),
    )
    return F.when(n <= k, 0).otherwise(F.element_at(bound, 1)).cast("long")


def measures(docs: DataFrame, carry: str | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> doc_id, every measure a rule may name, and the whole row of ``docs``
    as a struct named ``carry``."""
    if carry:  # the struct holds the only copy of the text
        docs, kept, at = docs.select(F.struct(*docs.columns).alias(carry)), [carry], f"{carry}."
    else:
        kept, at = [], ""
    text = F.coalesce(F.col(f"{at}text").cast("string"), F.lit(""))
    base = docs.select(F.col(f"{at}doc_id").alias("doc_id"), *(kept or [text.alias("_t")]), words_of(text).alias("_w"))
    text = F.coalesce(F.col(f"{carry}.text").cast("string"), F.lit("")) if carry else F.col("_t")
    base = base.withColumn("_n", F.size("_w"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    counted = base.select(
        "doc_id",
        *kept,
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        _count_of(text, SYMBOLS).cast("long").alias("n_symbols"),
        F.element_at(F.transform(F.array(lines), lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d"))), 1).alias("_l"),
        _repeat_words(F.col("_w"), F.col("_n")).alias("n_repeat_words"),
        F.size(F.filter("_w", lambda x: F.lower(x).isin(STOP_WORDS))).alias("_stops"),
        _count_of(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("_upper"),
        _count_of(text, "abcdefghijklmnopqrstuvwxyz").alias("_small"),
        _count_of(text, "!").alias("_marks"),
    )
    n = F.greatest("n_words", F.lit(1))
    return counted.select(
        "doc_id",
        *kept,
        "n_words",
        "word_chars",
        "n_symbols",
        F.col("_l.d").cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        (F.col("word_chars") / n).alias("mean_word_chars"),
        (F.col("n_symbols") / n).alias("symbols_per_word"),
        (F.col("_l.d") / F.greatest(F.col("_l.n"), F.lit(1))).alias("dup_line_share"),
        (F.col("_stops") / n).alias("stop_word_share"),
        (F.col("_upper") / F.greatest(F.col("_upper") + F.col("_small"), F.lit(1))).alias("upper_share"),
        (F.col("_marks") / n).alias("mark_share"),
        # a filter on the verdict stays above this projection instead of repeating all of it
        F.monotonically_increasing_id().alias("_row"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that a row of ``measures`` breaks."""
    broken = []
    for r in rules:
        out = F.lit(False)
        if r.least is not None:
            out = out | (F.col(r.measure) < r.least)
        if r.most is not None:
            out = out | (F.col(r.measure) > r.most)
        broken.append(F.when(out & (F.col("n_words") >= r.from_words), F.lit(r.name)))
    return F.array_compact(F.array(*broken))


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, carry: str | None = None) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> doc_id, the counts, ``base_failed``, ``kept``, ``broken``.

    One row per input row, in no order. base_failed: fewer than 10 words, or more than a fifth
    of the words in repeated 5-word windows. kept: neither base_failed nor a broken rule. A null
    text counts as empty and fails; null ids and repeated rows pass through; columns beside
    doc_id and text are ignored; with ``carry`` the whole row comes along as a struct of that name,
    which no column of the row can clash with. An empty table gives an empty result. The rule on
    stop words knows those of STOP_WORDS only: a longer text in a language without any of them is
    rejected, so give other ``rules`` for such a corpus.
    """
    out = measures(docs, carry).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    out = out.withColumn("broken", verdict(rules))
    return out.select(
        "doc_id",
        *([carry] if carry else []),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & (F.size("broken") == 0) & (F.col("_row") >= 0)).alias("kept"),
        F.array_join("broken", ",").alias("broken"),
    )
