"""From questions to verified answers: search, refusal, answer, second refusal, verification."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, KOREAN, Lexicon, Settings
from ..functions import text as T
from ..plans.store import written
from . import accounting, answers, search


@dataclass
class Answers:
    """answers(query_id, refused, mode, answer, sentences), a row for each question; evidence of the
    hits of those answered; verification, a row for each of their sentences; conflicts between their
    sources; citations(doc_id, cited)."""

    answers: DataFrame
    evidence: DataFrame
    verification: DataFrame
    conflicts: DataFrame
    citations: DataFrame


def ask(
    chunks: DataFrame,
    docs: DataFrame,
    queries: DataFrame,
    disabled: DataFrame | None = None,
    llm: Callable[[DataFrame], DataFrame] | None = None,
    nli: Callable[[DataFrame], DataFrame] | None = None,
    similarity: Callable[[Column, Column], Column] = answers.token_overlap,
    lexicon: Lexicon = KOREAN,
    settings: Settings = DEFAULT,
    kind: str = "tfidf",
    **options,
) -> Answers:
    """``chunks(cidx, doc_id, text)``, ``docs(doc_id, title, publisher, year, license)``,
    ``queries(query_id, text)`` -> Answers. ``options`` go to ``search.hybrid_search``.

    A question is refused where the search finds nothing good enough, and where no sentence of its
    answer cites anything: a model that finds no answer in its evidence says so by an empty one.
    """
    hits, signals = search.hybrid_search(chunks, queries, disabled, settings=settings, **options)
    verdict = written(signals.select("query_id", search.refused(kind, settings=settings).alias("unfound")), "verdict")
    evidence = answers.evidence_payload(hits.join(verdict.where("not unfound").select("query_id"), "query_id", "left_semi"), docs)
    evidence = written(evidence, "evidence")
    made = written(answers.generate(evidence, queries, llm, similarity, lexicon), "generated")
    out = queries.select("query_id").join(verdict, "query_id", "left").join(made, "query_id", "left")
    out = out.withColumn("unsaid", F.coalesce(search.refused_answer(F.col("sentences")), F.lit(True)))
    out = written(out, "answers")
    good = out.where("not unfound and not unsaid")
    sentences = good.select("query_id", F.posexplode("sentences").alias("sidx", "s")).select("query_id", "sidx", "s.text", "s.citations")
    used = evidence.join(good.select("query_id"), "query_id", "left_semi")
    checked = written(answers.verify_sentences(sentences, used, similarity, lexicon, settings, nli), "verified")
    said = F.when(F.coalesce("unfound", F.lit(True)), T.NOT_FOUND).when(F.col("unsaid"), T.NOT_ANSWERED).otherwise(F.col("answer"))
    refused = F.coalesce("unfound", F.lit(True)) | F.col("unsaid")
    shown = out.select(
        "query_id", refused.alias("refused"), F.when(~refused, F.col("mode")).alias("mode"), said.alias("answer"), F.when(~refused, F.col("sentences")).alias("sentences")
    )
    return Answers(shown, used, checked, answers.source_conflict(used, lexicon), accounting.citation_counts(checked, used))
