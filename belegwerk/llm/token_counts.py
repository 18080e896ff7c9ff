"""Token counts kept by source, language and tokenizer version, maintained from deltas.

A change carries a before image, an after image or both (a delete, an insert, a revision). Its
delta is minus the one and plus the other, so totals are sums of deltas and never need the
documents again. A batch is committed as a written folder below one named by its id: Spark's own
commit marker makes it all or nothing, and a batch delivered again finds it and changes nothing.
Writers need no lock: an attempt has a folder of its own, and where two writers of one batch both
end, readers take the first by name, which holds the same sums. Totals add up the folders' few
rows; ``compact`` folds those of one listing into one.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.ship import map_arrow
from .common import written
from .tokens import encoder

KEYS = ("source", "lang", "tokenizer_version")
_IMAGE = "struct<source:string,lang:string,tokenizer_version:string,n_tokens:bigint,n_chars:bigint>"
CHANGES = f"doc_id long, before {_IMAGE}, after {_IMAGE}"
_TOTALS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, n_chars long"


def deltas(changes: DataFrame) -> DataFrame:
    """``changes(doc_id, before, after)`` -> the summed signed counts by key, without zeros.

    An image is (source, lang, tokenizer_version, n_tokens, n_chars) or null. Keys may be null;
    null counts are 0. Changes that repeat count each time: only batches are idempotent.
    """
    sign = lambda name, n: F.struct(F.lit(n).alias("sign"), F.col(name).alias("image"))
    each = changes.select(F.explode(F.array(sign("before", -1), sign("after", 1))).alias("x")).where("x.image is not null")
    each = each.select(*[F.col(f"x.image.{k}").alias(k) for k in KEYS], F.col("x.sign").cast("long").alias("n"), "x.image.n_tokens", "x.image.n_chars")
    total = each.groupBy(*KEYS).agg(
        F.sum("n").alias("n_docs"),
        F.sum(F.col("n") * F.coalesce("n_tokens", F.lit(0))).alias("n_tokens"),
        F.sum(F.col("n") * F.coalesce("n_chars", F.lit(0))).alias("n_chars"),
    )
    return total.where("n_docs <> 0 or n_tokens <> 0 or n_chars <> 0")


class Rollup:
    """Totals under a folder that every executor reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _listed(self, path: str) -> list[str]:
        """Names of the folders below ``path``."""
        fs, of = self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(of(path)) if s.isDirectory()) if fs.exists(of(path)) else []

    def _done(self, folder: str) -> str | None:
        """The attempt of a batch or fold that readers take: the first that is committed."""
        fs, of = self._fs()
        return next((f"{folder}/{x}" for x in self._listed(f"{self.path}/{folder}") if fs.exists(of(f"{self.path}/{folder}/{x}/_SUCCESS"))), None)

    def committed(self) -> list[str]:
        """Names of the batches that are committed."""
        return [n for n in self._listed(f"{self.path}/batches") if self._done(f"batches/{n}")]

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch once; False if it was there already. A batch id names its content. What a
        broken attempt left is never read."""
        name = re.sub(r"[^\w.-]", lambda m: f"%{ord(m[0]):x}", str(batch_id)) or "%"
        if self._done(f"batches/{name}"):
            return False
        # the deltas of a batch are as many as its keys: one file
        deltas(changes).coalesce(1).write.parquet(f"{self.path}/batches/{name}/{uuid.uuid4().hex}")
        return True

    def _live(self) -> tuple[list[str], list[str]]:
        """The folders that make up the totals, the newest fold and the batches not in it, and the
        names of all those batches."""
        newest, known = None, set()
        for fold in reversed(self._listed(f"{self.path}/folds")):
            if (done := self._done(f"folds/{fold}/totals")) is not None:
                newest = done
                known = {r[0] for r in self.spark.read.schema("name string").parquet(f"{self.path}/folds/{fold}/names").collect()}  # a name for each batch
                break
        rest = {n: done for n in self._listed(f"{self.path}/batches") if n not in known and (done := self._done(f"batches/{n}"))}
        return [*([newest] if newest else []), *rest.values()], sorted(known | rest.keys())

    def _sums(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], _TOTALS)
        rows = self.spark.read.schema(_TOTALS).parquet(*[f"{self.path}/{n}" for n in folders])
        total = rows.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in ("n_docs", "n_tokens", "n_chars")])
        return total.where("n_docs <> 0 or n_tokens <> 0 or n_chars <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer_version, n_docs, n_tokens, n_chars) over all committed batches;
        keys whose documents are all deleted again are left out."""
        return self._sums(self._live()[0])

    def compact(self) -> None:
        """Fold all committed batches into one folder. Its sums and the names it holds are of one
        listing, so a batch that is committed meanwhile stays outside, and a folded batch
        delivered again is still known. Batch folders stay: they are the record."""
        folders, names = self._live()
        if len(folders) < 2:
            return
        target = f"{self.path}/folds/{len(names):012d}-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.parquet(f"{target}/names")
        self._sums(folders).coalesce(1).write.parquet(f"{target}/totals/{uuid.uuid4().hex}")


def counted(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``docs(doc_id, text, source, lang)`` with n_words, n_tokens and n_chars of the whole texts."""

    def run(batches):
        words = encoder(tokenizer)
        for batch in batches:
            sizes = [len(x) for lo in range(0, batch.num_rows, 1024) for x in words.encode(batch.column(1).slice(lo, 1024))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(sizes, pa.int64()), batch.column(4)], ["doc_id", "source", "lang", "n_tokens", "n_chars"]
            )

    cols = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
    ).withColumn("n_chars", F.length("text").cast("long"))
    return map_arrow(cols, run, "doc_id long, source string, lang string, n_tokens long, n_chars long")


def image(version: str, tokens: Column) -> Column:
    return F.struct(F.col("source"), F.col("lang"), F.lit(version).alias("tokenizer_version"), tokens.cast("long").alias("n_tokens"), F.col("n_chars"))


def maintained(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """Totals of ``docs(doc_id, text, source, lang, ...)`` after three batches and a redelivery.

    The first batch inserts every document under version 1 of the counts (its token ids), the
    second revises each to version 2 (with an end id), the third deletes documents without text;
    the second is then delivered again and changes nothing. Null and empty texts count as no
    tokens; keys may be null; repeated rows count each; other columns are ignored; an empty table
    has no totals.
    """
    spark = docs.sparkSession
    counts = written(counted(docs, tokenizer), "token-counts")
    none = F.lit(None).cast(_IMAGE)
    one, two = image(f"{tokenizer}/1", F.col("n_tokens")), image(f"{tokenizer}/2", F.col("n_tokens") + 1)
    insert = counts.select("doc_id", none.alias("before"), one.alias("after"))
    revise = counts.select("doc_id", one.alias("before"), two.alias("after"))
    delete = counts.where("n_chars = 0").select("doc_id", two.alias("before"), none.alias("after"))
    rollup = Rollup(spark, path)
    for batch, changes in (("1-insert", insert), ("2-revise", revise), ("3-delete", delete), ("2-revise", revise)):
        rollup.commit(batch, changes)
    return rollup.totals()
