"""A training corpus from raw documents: rules, near copies, repeated spans, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as
the next one's docs. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from belegwerk.llm.common import read_table, written  # noqa: F401  written: for callers that keep a stage
from belegwerk.llm.near_dedup import near_duplicates
from belegwerk.llm.packing import packed
from belegwerk.llm.pii import KEY_SETTING, TABLE_KEY, pseudonymised
from belegwerk.llm.quality_rules import quality_rules
from belegwerk.llm.substring_dedup import without_repeats
from belegwerk.plans.store import kept_alone

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame, given: DataFrame) -> DataFrame:
    """The columns of documents, in their order, with n_chars counted anew."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*given.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. The verdict is made in the scan's own rows. Null, empty
    and blank texts go; repeated rows are judged each; an empty table stays empty."""
    return quality_rules(docs, carry="row").where("kept").select("row.*")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest id. Texts without words
    and rows without an id are in no group and stay; rows that repeat an id stay or go together."""
    kept = near_duplicates(docs, k=5, percent=80).where("not kept").select("doc_id")
    return docs.join(kept, "doc_id", "left_anti").select(*docs.columns)


def spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long spans that earlier ones have; those that only were copies go. Null
    and short texts, and rows without an id, stay as they are; rows that repeat an id are cut each."""
    cut = without_repeats(docs, keep_text=True, carry="row")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("row.text"))
    out = cut.where("n_removed = 0 or kept_text <> ''").select(*[text.alias(c) if c == "text" else F.col(f"row.{c}") for c in docs.columns])
    return _documents(out, docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data under pseudonyms, by the session's key; without one, by that of
    invented tables. Null texts stay null."""
    return _documents(pseudonymised(docs, spark.conf.get(KEY_SETTING, None) or TABLE_KEY), docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences; a null or empty text is its end id alone."""
    return packed(docs)


STAGES = [("quality_rules", rules), ("near_dedup", near_copies), ("substring_dedup", spans), ("pii", private), ("packing", sequences)]

#: Token ids and keyed digests are beyond SQL; the tests hold the stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents. A stage's intermediate tables go once its result is written."""
    docs = read_table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = kept_alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
