"""Quality of search, refusal and citation over labelled questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, KOREAN, Lexicon, Settings
from ..plans.store import written
from . import accounting, answers, search


def evaluate(
    questions: DataFrame, chunks: DataFrame, k: int = 5, lexicon: Lexicon = KOREAN, settings: Settings = DEFAULT, kind: str = "tfidf", similarity=answers.token_overlap, **options
) -> DataFrame:
    """``questions(query_id, question, relevant_docs, is_negative)`` of ``feedback.read_questions``,
    ``chunks(cidx, doc_id, text)`` -> one row: n_positive, n_negative, recall, mrr, refusal_recall,
    false_refusal, n_answered, mean_similarity, weak, contradiction, uncited.

    Recall and mrr are over the positive questions, by the best rank of any relevant document among
    k hits; citations are those of the extractive answers to positive questions that are not
    refused. relevant_docs holds doc_ids as strings. ``options`` go to ``search.hybrid_search``.
    """
    asked = questions.select("query_id", F.col("question").alias("text"))
    hits, signals = search.hybrid_search(chunks, asked, k=k, settings=settings, **options)
    flags = questions.select("query_id", "is_negative")
    positive = flags.where("not is_negative")
    relevant = questions.where("not is_negative").select("query_id", F.explode("relevant_docs").alias("doc_id")).distinct()
    named = hits.withColumn("doc_id", F.col("doc_id").cast("string"))
    found = accounting.recall_mrr(named, relevant, positive).select(F.col("n").alias("n_positive"), "recall", "mrr")
    verdict = written(signals.select("query_id", search.refused(kind, settings=settings).alias("refused")).join(flags, "query_id"), "verdict")
    rates = accounting.refusal_rates(verdict)
    answered = written(hits.join(verdict.where("not is_negative and not refused").select("query_id"), "query_id", "left_semi"), "answered")
    sentences = answers.extractive_answer(answered, asked, similarity).select("query_id", "sidx", "text", "citations")
    cited = accounting.faithfulness(answers.verify_sentences(sentences, answered, similarity, lexicon, settings))
    counts = flags.agg(F.count_if("is_negative").alias("n_negative")).crossJoin(answered.agg(F.count_distinct("query_id").alias("n_answered")))
    return found.crossJoin(counts).crossJoin(rates).crossJoin(cited)  # one row each
