"""Citation accounting, the source catalogue, and evaluation metrics."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, KOREAN, Lexicon, Settings
from ..functions import text as T
from ..plans.ship import map_arrow


def citation_counts(sentences: DataFrame, evidence: DataFrame) -> DataFrame:
    """``sentences(query_id, sidx, citations)``, ``evidence(query_id, rank, doc_id)`` -> doc_id, cited:
    one for each sentence and distinct citation."""
    each = sentences.select("query_id", "sidx", F.explode(F.array_distinct("citations")).alias("rank"))
    return each.join(evidence.select("query_id", "rank", "doc_id"), ["query_id", "rank"]).groupBy("doc_id").agg(F.count("*").alias("cited"))


def contribution_share(counts: DataFrame) -> DataFrame:
    """``counts(doc_id, cited)`` with each one's share of all, to 3 places."""
    total = counts.agg(F.sum("cited").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("doc_id", "cited", F.round(F.col("cited") / F.col("total"), 3).alias("share"))


def source_catalog(docs: DataFrame, counts: DataFrame, disabled: DataFrame) -> DataFrame:
    """``docs(doc_id, title, ...)`` with cited and enabled, most cited first, then by title."""
    off = disabled.select("doc_id").distinct().withColumn("off", F.lit(True))
    out = docs.join(counts, "doc_id", "left").join(off, "doc_id", "left")
    return out.withColumn("cited", F.coalesce("cited", F.lit(0))).withColumn("enabled", F.col("off").isNull()).drop("off").orderBy(F.col("cited").desc(), "title", "doc_id")


def toggle_sources(disabled: DataFrame, changes: DataFrame, docs: DataFrame) -> DataFrame:
    """``changes(doc_id, enabled)`` applied to ``disabled(doc_id)``; unknown documents are ignored, and
    listed by ``unknown_sources``."""
    known = changes.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    kept = disabled.select("doc_id").join(known.where("enabled"), "doc_id", "left_anti")
    return kept.union(known.where("not enabled").select("doc_id")).distinct()


def unknown_sources(changes: DataFrame, docs: DataFrame) -> DataFrame:
    """The doc_ids of ``changes`` that no document has."""
    return changes.select("doc_id").distinct().join(docs.select("doc_id"), "doc_id", "left_anti")


def recall_mrr(hits: DataFrame, relevant: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """``hits(query_id, rank, doc_id)``, ``relevant(query_id, doc_id)`` -> n, recall (share of the
    questions with a relevant hit) and mrr, by the best rank of any relevant document. The questions
    are those of ``asked(query_id)``, or all that have a relevant document."""
    best = relevant.join(hits, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("rank").alias("best"))
    asked = (relevant if asked is None else asked).select("query_id").distinct().join(best, "query_id", "left")
    return asked.agg(
        F.count("*").alias("n"),
        F.avg(F.when(F.col("best").isNotNull(), 1.0).otherwise(0.0)).alias("recall"),
        F.avg(F.coalesce(1.0 / F.col("best"), F.lit(0.0))).alias("mrr"),
    )


def containing(passages: DataFrame, docs: DataFrame, most: int = 100_000) -> DataFrame:
    """``passages(query_id, text)``, ``docs(doc_id, body)`` -> query_id, doc_id: the documents that
    hold a passage whole, white space aside. Blank passages are in none.

    Up to ``most`` passages are one automaton that every task walks its documents through once, so
    the work is linear in the documents. More passages go over it in parts of that size.
    """
    asked = passages.select("query_id", T.squash(F.col("text")).alias("p")).where("p <> ''")
    parts = max(1, -(-asked.count() // most))
    texts = docs.select("doc_id", T.squash(F.col("body")).alias("t"))
    out = None
    for i in range(parts):
        some = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("p"), F.lit(parts)) == i)
        found = _held(texts, sorted({r[0] for r in some.select("p").collect()}))  # about ``most`` passages
        out = found if out is None else out.unionByName(found)
    return out.join(asked, "p").select("query_id", "doc_id").distinct()


def _held(texts: DataFrame, passages: list[str]) -> DataFrame:
    given = texts.sparkSession.sparkContext.broadcast(passages)

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for p in given.value:
            automaton.add_word(p, p)
        automaton.make_automaton() if given.value else None
        for batch in batches:
            rows, found = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for p in {p for _, p in automaton.iter(t)} if t and given.value else ():
                    rows.append(i), found.append(p)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], ["doc_id", "p"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return map_arrow(texts, run, f"doc_id {kind}, p string")


def refusal_rates(outcomes: DataFrame) -> DataFrame:
    """``outcomes(query_id, is_negative, refused)`` -> refusal_recall and false_refusal."""
    neg, pos = F.col("is_negative"), ~F.col("is_negative")
    return outcomes.agg(
        (F.count_if(neg & F.col("refused")) / F.greatest(F.count_if(neg), F.lit(1))).alias("refusal_recall"),
        (F.count_if(pos & F.col("refused")) / F.greatest(F.count_if(pos), F.lit(1))).alias("false_refusal"),
    )


def faithfulness(rows: DataFrame) -> DataFrame:
    """``rows(status, similarity, warn)`` -> mean similarity of cited sentences, and the shares of
    weak, contradicting and uncited ones among all but the advisory."""
    cited = F.col("similarity").isNotNull()
    all_ = F.greatest(F.count_if(F.col("status") != "advisory"), F.lit(1))
    return rows.agg(
        F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("mean_similarity"),
        (F.count_if(cited & F.col("warn") & (F.col("status") != "contradiction")) / all_).alias("weak"),
        (F.count_if(F.col("status") == "contradiction") / all_).alias("contradiction"),
        (F.count_if(F.col("status") == "uncited") / all_).alias("uncited"),
    )


def answer_summary(rows: DataFrame) -> DataFrame:
    """Counts by answer of contradicting, weak and uncited sentences."""
    weak = F.col("warn") & (F.col("status") == "grounded")
    return rows.groupBy("query_id").agg(
        F.count_if(F.col("status") == "contradiction").alias("n_contradiction"), F.count_if(weak).alias("n_weak"), F.count_if(F.col("status") == "uncited").alias("n_uncited")
    )


def domain_filter(docs: DataFrame, lexicon: Lexicon = KOREAN, settings: Settings = DEFAULT) -> DataFrame:
    """``docs(doc_id, body)`` of the domain, with the number of markers and their density."""
    distinct, density = T.domain_stats(F.col("body"), lexicon)
    out = docs.select("doc_id", F.length("body").alias("n_chars"), distinct.alias("n_distinct"), F.round(density, 2).alias("score"), density.alias("density"))
    kept = out.where((F.col("n_chars") >= settings.min_length) & (F.col("n_distinct") >= settings.min_distinct) & (F.col("density") >= settings.min_density))
    return kept.drop("density")


def collector_rank(kept: DataFrame, most: int = DEFAULT.max_keep) -> DataFrame:
    """The densest articles: the cap is the report's own."""
    return kept.orderBy(F.col("score").desc(), "doc_id").limit(most)


