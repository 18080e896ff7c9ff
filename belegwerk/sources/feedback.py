"""Questions, feedback, log lines and the state of sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import cut_text

MARK = "[FEEDBACK]"
QUESTIONS = "question string, relevant_docs array<string>, relevant_doc string, is_negative boolean"
FEEDBACK = "ts string, question string, answer string, rating string, comment string, mode string"


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines -> query_id, question, relevant_docs, is_negative; blank lines are skipped and a
    single relevant document is a list of one. A question that repeats is one by itself each time."""
    raw = spark.read.schema(QUESTIONS).json(path).where("question is not null")
    one = F.when(F.col("relevant_doc").isNotNull(), F.array("relevant_doc")).otherwise(F.array().cast("array<string>"))
    rows = raw.select("question", F.coalesce("relevant_docs", one).alias("relevant_docs"), F.coalesce("is_negative", F.lit(False)).alias("is_negative"))
    again = F.row_number().over(Window.partitionBy("question").orderBy("is_negative", "relevant_docs"))
    return rows.withColumn("again", again).select(F.xxhash64("question", "again").alias("query_id"), "question", "relevant_docs", "is_negative")


def feedback_rows(df: DataFrame) -> DataFrame:
    """Feedback as it is stored: long fields cut, and stamped where it has no time."""
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    cut = {"question": 500, "answer": 2000, "comment": 500}
    return df.select(F.coalesce("ts", now).alias("ts"), *[cut_text(F.col(c), cut[c]).alias(c) if c in cut else F.col(c) for c in ("question", "answer", "rating", "comment", "mode")])


def append_feedback(df: DataFrame, path: str) -> None:
    feedback_rows(df).write.mode("append").json(path)


def stream_feedback(stream: DataFrame, path: str, checkpoint: str, **trigger):
    """A running query that appends a stream of feedback to a folder of JSON lines, each row once."""
    return feedback_rows(stream).writeStream.format("json").option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start(path)


def log_lines(df: DataFrame) -> DataFrame:
    return feedback_rows(df).select(F.concat(F.lit(f"{MARK} "), F.to_json(F.struct("*"))).alias("value"))


def from_log(lines: DataFrame, schema: str = FEEDBACK) -> DataFrame:
    """``lines(value)``, a batch or a stream -> the feedback in lines with the mark."""
    body = F.regexp_extract("value", r"(?s)\[FEEDBACK\]\s*(\{.*\})", 1)
    return lines.where(F.col("value").contains(MARK)).select(F.from_json(body, schema).alias("f")).select("f.*")


def _fs(spark: SparkSession, path: str):
    of = spark._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark._jsc.hadoopConfiguration()), of


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Complete versions of a state table, oldest first."""
    fs, of = _fs(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(of(path)) if s.isDirectory()] if fs.exists(of(path)) else []
    return sorted(n for n in names if n.startswith("version-") and fs.exists(of(f"{path}/{n}/_SUCCESS")))


def read_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The newest complete version of a stored table, empty where there is none yet."""
    found = _versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/{found[-1]}") if found else spark.createDataFrame([], schema)


def write_state(df: DataFrame, path: str) -> None:
    """Replace a state table, which may be read from the same place. A version counts once its
    commit marker is there, so a crash leaves the one before; that one stays for its readers, and
    older ones go."""
    spark = df.sparkSession
    before = _versions(spark, path)
    number = int(before[-1].split("-")[1]) + 1 if before else 0
    df.write.parquet(f"{path}/version-{number:012d}-{uuid.uuid4().hex}")
    fs, of = _fs(spark, path)
    for old in before[:-1]:
        fs.delete(of(f"{path}/{old}"), True)
