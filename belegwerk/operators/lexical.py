"""BM25 over stored term counts of chunks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import Analyzer, tokens
from ..plans.store import written

# fixed values
K1, B, EPSILON = 1.5, 0.75, 0.25
#: Rows of query terms up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 200_000


@dataclass
class LexicalIndex:
    """counts(cidx, dl, entries array<struct<term, tf>>), a row for each chunk; terms(term, df, idf);
    stats(n, avgdl): three tables that can be stored. Statistics cover the whole corpus whatever
    sources are switched off."""

    counts: DataFrame
    terms: DataFrame
    stats: DataFrame

    @property
    def postings(self) -> DataFrame:
        return self.counts.select("cidx", "dl", F.explode("entries").alias("e")).select("cidx", "e.term", "e.tf", "dl")


def run_lengths(ws: Column) -> Column:
    """Each distinct word of an array and how often it stands there."""

    def counted(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))
        runs = lambda at: F.zip_with(
            at, F.concat(F.slice(at, 2, F.size(at)), F.array(F.size(s) + 1)), lambda a, b: F.struct(F.element_at(s, a).alias("term"), (b - a).cast("long").alias("tf"))
        )
        return F.element_at(F.transform(F.array(starts), runs), 1)

    none = F.array().cast("array<struct<term:string,tf:bigint>>")
    return F.when(F.size(ws) > 0, F.element_at(F.transform(F.array(F.array_sort(ws)), counted), 1)).otherwise(none)


def build_index(chunks: DataFrame, analyzer: Analyzer | None = None, store: bool = True) -> LexicalIndex:
    """``chunks(cidx, text)`` -> the index. Chunks are tokenised once, row by row; document
    frequencies are combining aggregates, the corpus statistics one row. With ``store`` the counts
    and the terms are written to the shared folder, so that no reader makes them again."""
    keep = written if store else lambda df, _: df
    worded = chunks.select("cidx", tokens(F.col("text"), analyzer).alias("ws"))
    counts = keep(worded.select("cidx", F.size("ws").alias("dl"), run_lengths(F.col("ws")).alias("entries")), "counts")
    stats = counts.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    df = counts.select(F.explode("entries.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = keep(df, "frequencies").crossJoin(F.broadcast(stats)).select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    terms = raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, F.col("mean") * EPSILON).otherwise(F.col("raw")).alias("idf"))
    return LexicalIndex(counts, keep(terms, "terms"), stats)


def write_lexical(index: LexicalIndex, folder: str) -> None:
    for name in ("counts", "terms", "stats"):
        getattr(index, name).write.mode("overwrite").parquet(f"{folder}/{name}")


def read_lexical(spark: SparkSession, folder: str) -> LexicalIndex:
    return LexicalIndex(*[spark.read.parquet(f"{folder}/{name}") for name in ("counts", "terms", "stats")])


def bm25_scores(index: LexicalIndex, queries: DataFrame, analyzer: Analyzer | None = None) -> DataFrame:
    """``queries(query_id, text)`` -> query_id, cidx, bm25 for the chunks that share a term. Terms
    repeated in a query add up again.

    Where the query terms are few, they are broadcast, and the counts are dealt by chunk before the
    join: the sums of a chunk are then made where they are, and no match is shuffled.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("text"), analyzer)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    weighted = asked.join(index.terms.select("term", "idf"), "term").select("term", "query_id", (F.col("times") * F.col("idf")).alias("weight"))
    norm = K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm)
    if asked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        dealt = LexicalIndex(index.counts.repartition("cidx"), index.terms, index.stats)
        met = dealt.postings.join(F.broadcast(weighted), "term")
    else:
        met = index.postings.join(weighted, "term")
    return met.crossJoin(F.broadcast(index.stats)).groupBy("query_id", "cidx").agg(F.sum(part).alias("bm25"))


def bm25_pairs(pairs: DataFrame, chunks: DataFrame, queries: DataFrame, terms: DataFrame, stats: DataFrame, analyzer: Analyzer | None = None) -> DataFrame:
    """``pairs(query_id, cidx)`` -> query_id, cidx, bm25 of those that share a term; their chunks are
    tokenised, and no others."""
    held = chunks.join(pairs.select("cidx").distinct(), "cidx", "left_semi")
    counts = LexicalIndex(held.select("cidx", tokens(F.col("text"), analyzer).alias("ws")).select("cidx", F.size("ws").alias("dl"), run_lengths(F.col("ws")).alias("entries")), terms, stats).postings
    asked = queries.select("query_id", F.explode(tokens(F.col("text"), analyzer)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    asked = asked.join(terms.select("term", "idf"), "term")
    met = pairs.join(counts, "cidx").join(asked, ["query_id", "term"]).crossJoin(F.broadcast(stats))
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return met.groupBy("query_id", "cidx").agg(F.sum(part).alias("bm25"))


def top_ranked(scores: DataFrame, score: str, k: int, rank: str) -> DataFrame:
    """The k best per query, ranks from 1; ties by the order of the corpus. Only k rows of each
    query leave a task."""
    order = Window.partitionBy("query_id").orderBy(F.col(score).desc(), "cidx")
    return scores.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def zero_filled(scores: DataFrame, queries: DataFrame, allowed: DataFrame, k: int) -> DataFrame:
    """Scores with the first k chunks of the corpus at zero for each query where it has no score:
    what a full ranking shows once the matches run out. Only k chunks per query are added."""
    first = allowed.select("cidx").orderBy("cidx").limit(2 * k)
    blank = queries.select("query_id").crossJoin(F.broadcast(first)).join(scores.select("query_id", "cidx"), ["query_id", "cidx"], "left_anti")
    return scores.select("query_id", "cidx", "bm25").unionByName(blank.withColumn("bm25", F.lit(0.0)))
