"""Streaming queries: each runs over the table as a stream until it has read all of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.feedback import FEEDBACK, from_log, stream_feedback
from ..streaming import gate
from .catalog import PROSE_MARKS, query
from .store import fresh_path


def drained(stream, mode: str):
    """The rows of a finite stream: appended to a table in the shared folder, or for a complete
    result the newest of the tables that its batches replace."""
    spark = stream.sparkSession
    path, checkpoint = fresh_path(spark, "stream"), fresh_path(spark, "stream-checkpoint")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(path).awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)
    seen = []

    def replace(batch, number):
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        seen.append(number)

    writer.foreachBatch(replace).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/{max(seen)}") if seen else spark.createDataFrame([], stream.schema)


def _stream(spark, sf, name):
    where = f"{sf}/{name}.parquet"
    # a pattern, since a stream takes folders only and a table may be one file
    return spark.readStream.schema(spark.read.parquet(where).schema).parquet(f"{sf}/{name}.parqu[e]t")


#: Answers by turn: as they are, without a mark of evidence, the sentinel, broken off with or
#: without a fallback. All but the first kind end in a refusal, unless the fallback cites.
@query("stream_sentinel_gate", f"""
WITH a AS (SELECT conv_id || '-' || turn AS request_id, turn, coalesce(text, '') || CASE WHEN turn % 5 = 0 THEN ' [1]' WHEN turn % 5 = 4 THEN ' [9]' ELSE '' END AS text FROM conversations),
k AS (SELECT *, CASE WHEN turn % 5 IN (1, 4) THEN text WHEN turn % 5 = 0 THEN text ELSE '' END AS said FROM a)
SELECT request_id,
  CASE WHEN turn % 5 = 3 THEN 'fallback [2]' WHEN turn % 5 = 2 THEN '' WHEN length(said) < 13 AND regexp_replace(said, '{PROSE_MARKS}', '', 'g') = '' THEN '' ELSE said END AS answer,
  turn % 5 IN (1, 2, 4) AS refused FROM k""")
def stream_sentinel_gate(spark, sf):
    c = _stream(spark, sf, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    kind = F.col("turn") % 5
    answer = F.when(kind == 2, T.SENTINEL).when(kind == 0, F.concat("text", F.lit(" [1]"))).when(kind == 3, "brok").when(kind == 4, F.concat("text", F.lit(" [9]"))).otherwise(F.col("text"))
    cut = F.call_function("div", F.greatest(F.length(answer) - 1, F.lit(0)), F.lit(7))
    parts = F.transform(F.sequence(F.lit(0).cast("bigint"), cut), lambda i: F.substr(answer, (i * 7 + 1).cast("int"), F.lit(7)))
    tokens = c.select(F.concat_ws("-", "conv_id", "turn").alias("request_id"), kind.alias("kind"), parts.alias("p"))
    tokens = tokens.select("request_id", "kind", F.size("p").alias("n"), F.posexplode("p").alias("seq", "token"))
    last = F.col("seq") + 1 == F.col("n")
    tokens = tokens.select(
        "request_id", F.col("seq").cast("long").alias("seq"), "token", last.alias("last"), F.lit(2).alias("n_evidence"),
        ((F.col("kind") == 3) & last).alias("failed"), F.lit("fallback [2]").alias("fallback"),
    )
    return gate.ordered_text(drained(gate.gate(tokens), "append"))


@query("stream_citation_counts", "SELECT user_id AS doc_id, count(*) AS cited FROM events WHERE event_type = 'click' GROUP BY 1")
def stream_citation_counts(spark, sf):
    e = _stream(spark, sf, "events").where("event_type = 'click'").select(F.col("user_id").alias("doc_id"))
    return drained(gate.citation_stream(e), "complete")


@query("stream_windowed_citations", """
SELECT strftime(ts, '%Y-%m-%d %H') AS begun, user_id AS doc_id, count(*) AS cited FROM events GROUP BY 1, 2""")
def stream_windowed_citations(spark, sf):
    """An extension: hourly counts by event time; in complete mode, so the last hours show too."""
    e = _stream(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("doc_id"))
    return drained(gate.windowed_citations(e), "complete").select(F.date_format("window.start", "yyyy-MM-dd HH").alias("begun"), "doc_id", "cited")


@query("stream_feedback_append", """
SELECT 'q' || event_id AS question, event_type AS rating, left(coalesce(props, ''), 500) AS comment FROM events WHERE event_id % 2 = 0""")
def stream_feedback_append(spark, sf):
    """Feedback in log lines, parsed as a stream, appended to a folder of JSON lines and read back."""
    e = _stream(spark, sf, "events")
    sent = F.struct(F.concat(F.lit("q"), "event_id").alias("question"), F.col("event_type").alias("rating"), F.coalesce("props", F.lit("")).alias("comment"))
    lines = e.select(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("10:00 [FEEDBACK] "), F.to_json(sent))).otherwise("other").alias("value"))
    path = fresh_path(spark, "feedback")
    stream_feedback(from_log(lines), path, fresh_path(spark, "feedback-checkpoint"), availableNow=True).awaitTermination()
    return spark.read.schema(FEEDBACK).json(path).select("question", "rating", "comment")
