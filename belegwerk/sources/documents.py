"""Document files into ``docs(doc_id, meta, body, error)`` rows, and the stored index."""

from __future__ import annotations

import io
import re
import subprocess
import tempfile
import uuid
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import KOREAN, Lexicon
from ..functions import text as T
from ..operators.accounting import collector_rank, domain_filter
from ..operators.lexical import LexicalIndex, write_lexical
from ..plans.ship import ship

EXTENSIONS = ("md", "pdf", "hwp", "hwpx")
_TAG = re.compile(r"<[^>]+>")


def meta_of(text: Column) -> Column:
    """``key: value`` lines as a map; the last of equal keys wins, lines without a colon are none."""
    lines = F.filter(F.split(T.strip(text), T.LINE_END), lambda x: x.contains(":"))
    pair = lambda x: F.struct(T.strip(F.substring_index(x, ":", 1)).alias("k"), T.strip(F.regexp_replace(x, r"(?s)^[^:]*:", "")).alias("v"))
    pairs = F.transform(lines, pair)
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def front_matter(df: DataFrame, column: str) -> DataFrame:
    """``df`` with meta and body: the first line ``---`` on its own ends the head, wherever it is."""
    raw = F.col(column)
    at = F.instr(raw, "\n---\n")
    head = F.when(at > 0, F.left(raw, at - 1)).otherwise("")
    body = F.when(at > 0, F.substr(raw, at + 5)).otherwise(raw)
    return df.withColumn("_head", head).withColumn("meta", meta_of(F.col("_head"))).withColumn("body", body).drop("_head", column)


def strip_tags(x: Column) -> Column:
    return F.regexp_replace(x, _TAG.pattern, " ")


def _pdf(data: bytes) -> list[str]:
    """The text of each page."""
    import fitz  # an optional library

    with fitz.open(stream=data, filetype="pdf") as pages:
        return [page.get_text() for page in pages]


def _hwpx(data: bytes) -> list[str]:
    """The text of each section: what the XML of its content says outside tags, a space for each."""
    texts = []
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        for entry in archive.infolist():
            if entry.filename.startswith("Contents/") and entry.filename.endswith(".xml"):
                texts.append(strip_tags_of(archive.read(entry).decode("utf-8", "ignore")))
    return texts


def strip_tags_of(xml: str) -> str:
    """As ``strip_tags``, of a string."""
    return _TAG.sub(" ", xml)


def _hwp(data: bytes) -> list[str]:
    with tempfile.NamedTemporaryFile(suffix=".hwp") as f:  # read again by this same task only
        f.write(data)
        f.flush()
        out = subprocess.run(["hwp5txt", f.name], capture_output=True, timeout=60, check=True)
    return [out.stdout.decode("utf-8", "ignore")]


#: The parts of a file by its extension, and what joins them.
READERS: dict[str, Callable[[bytes], list[str]]] = {"md": lambda b: [b.decode("utf-8")], "pdf": _pdf, "hwpx": _hwpx, "hwp": _hwp}
BETWEEN = {"pdf": "\n\n"}


def extracted(files: DataFrame) -> DataFrame:
    """``files(path, ext, content)`` -> path, ext, raw, error. A file that can't be read has an
    error and no text; the others go on."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, ext, content in zip(pdf["path"], pdf["ext"], pdf["content"]):
                try:
                    rows.append((path, ext, BETWEEN.get(ext, "\n").join(READERS[ext](bytes(content))), None))
                except Exception as e:  # noqa: BLE001  each file by itself, reported in its row
                    rows.append((path, ext, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "ext", "raw", "error"])

    ship(files.sparkSession)
    return files.select("path", "ext", "content").mapInPandas(run, "path string, ext string, raw string, error string")


def read_documents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """All documents of a folder -> (docs(doc_id, meta, body), skipped(path, error)).

    Markdown has its metadata in front; other formats have them in a ``<file>.meta`` beside, with
    the file's stem as the title by default. Bodies are cleaned. Extensions match in any case. Of
    files with one stem the last in order of their paths is the document; the others are skipped.
    """
    all_files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", "content")
    name = F.substring_index("path", "/", -1)
    files = all_files.withColumn("name", name).withColumn("ext", F.lower(F.substring_index("name", ".", -1)))
    text = extracted(files.where(F.col("ext").isin(*EXTENSIONS)))
    side = files.where("ext = 'meta'").select(F.expr("left(path, length(path) - 5)").alias("path"), F.decode("content", "UTF-8").alias("side"))
    good = text.where("error is null").join(side, "path", "left").withColumn("stem", F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", ""))
    with_head = front_matter(good.withColumn("copy", F.col("raw")), "copy")
    is_md = F.col("ext") == "md"
    side_meta = meta_of(F.coalesce("side", F.lit("")))
    titled = F.when(F.map_contains_key(side_meta, "title"), side_meta).otherwise(F.map_concat(side_meta, F.create_map(F.lit("title"), F.col("stem"))))
    last = Window.partitionBy("stem").orderBy(F.col("path").desc())
    with_head = with_head.withColumn("nth", F.row_number().over(last))
    twins = with_head.where("nth > 1").select("path", F.concat(F.lit("another file is the document "), "stem").alias("error"))
    docs = with_head.where("nth = 1").select(
        F.col("stem").alias("doc_id"), F.when(is_md, F.col("meta")).otherwise(titled).alias("meta"), T.clean_extracted(F.when(is_md, F.col("body")).otherwise(F.col("raw"))).alias("body")
    )
    return docs, text.where("error is not null").select("path", "error").unionByName(twins)


def write_index(docs: DataFrame, chunks: DataFrame, folder: str, kind: str, lexical: LexicalIndex | None = None) -> None:
    """docs, chunks (with their vectors as a column), the kind of the vectors, and the lexical index,
    which ``lexical.read_lexical`` reads from ``<folder>/lexical``."""
    if lexical:
        write_lexical(lexical, f"{folder}/lexical")
    docs.write.mode("overwrite").parquet(f"{folder}/docs")
    chunks.write.mode("overwrite").parquet(f"{folder}/chunks")
    docs.sparkSession.createDataFrame([(kind,)], "kind string").write.mode("overwrite").json(f"{folder}/backend")


def read_index(spark: SparkSession, folder: str, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(docs, chunks); vectors of another kind than asked for are refused."""
    found = spark.read.schema("kind string").json(f"{folder}/backend").first()["kind"]
    if kind and kind != found:
        raise ValueError(f"the index holds {found} vectors, not {kind}")
    return spark.read.parquet(f"{folder}/docs"), spark.read.parquet(f"{folder}/chunks")


def write_markdown(articles: DataFrame, folder: str, license_text: str, portal: str, prefix: str = "portal_") -> None:
    """``articles(sn, title, body)`` as files ``<prefix><sn>_<title>.md`` with front matter, as
    ``read_documents`` reads them; files of that prefix that were there go once the new ones are
    written. The articles are a collector's, a few hundred: the driver renames each file."""
    spark = articles.sparkSession
    jvm = spark._jvm
    of = jvm.org.apache.hadoop.fs.Path
    fs = of(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    head = F.concat_ws("\n", F.concat(F.lit("title: "), "title"), F.lit(f"url: {portal}"), F.lit(f"license: {license_text}"))
    name = F.concat(F.lit(prefix), F.col("sn").cast("string"), F.lit("_"), T.safe_name(F.col("title")))
    beside = f"{folder}/_writing-{uuid.uuid4().hex}"
    rows = articles.select(F.hex(F.encode(name, "UTF-8")).alias("name"), F.concat(head, F.lit("\n---\n"), "body").alias("value"))
    rows.write.partitionBy("name").option("lineSep", "\n").text(beside)
    before = [s.getPath() for s in fs.listStatus(of(folder)) if s.isFile() and s.getPath().getName().startswith(prefix)]
    for path in before:
        fs.delete(path, False)
    for made in fs.listStatus(of(beside)):
        if made.isDirectory():
            file = bytes.fromhex(made.getPath().getName().removeprefix("name=")).decode("utf-8") + ".md"
            part = next(s.getPath() for s in fs.listStatus(made.getPath()) if s.getPath().getName().startswith("part-"))
            fs.rename(part, of(folder, file))
    fs.delete(of(beside), True)


def collect_articles(articles: DataFrame, folder: str, license_text: str, portal: str, lexicon: Lexicon = KOREAN) -> DataFrame:
    """The portal's articles that belong to the domain, the densest ones first, written to
    ``folder``; returns them with their score."""
    kept = collector_rank(domain_filter(articles.select(F.col("sn").alias("doc_id"), "body"), lexicon))
    out = articles.join(kept.select(F.col("doc_id").alias("sn"), "score"), "sn")
    write_markdown(out, folder, license_text, portal)
    return out
