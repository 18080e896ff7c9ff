"""Articles of a health portal's XML, by regular expressions over CDATA."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def article_list(df: DataFrame, column: str) -> DataFrame:
    """XML lists -> sn, title of every item that has both."""
    items = df.select(F.explode(F.regexp_extract_all(column, F.lit(r"(?s)<cntntsList>(.*?)</cntntsList>"), 1)).alias("item"))
    subject = F.regexp_extract("item", r"(?s)<CNTNTS_SJ>(.*?)</CNTNTS_SJ>", 1)
    out = items.select(
        F.regexp_extract("item", r"<CNTNTS_SN><!\[CDATA\[(\d+)\]\]>", 1).alias("sn"),
        T.strip(F.regexp_extract(subject, r"(?s)<!\[CDATA\[(.*?)\]\]>", 1)).alias("title"),
        subject.contains("<![CDATA[").alias("titled"),
    )
    return out.where("sn <> '' and titled").drop("titled")


def article(df: DataFrame, column: str) -> DataFrame:
    """``df`` with title, sections(name, text) and body in place of the XML. Sections of
    references and keywords are left out, and empty ones."""
    inside = lambda x, tag: T.strip(F.regexp_extract(x, rf"(?s)<{tag}><!\[CDATA\[(.*?)\]\]>", 1))
    blocks = F.regexp_extract_all(column, F.lit(r"(?s)<cntntsCl>(.*?)</cntntsCl>"), 1)
    made = F.transform(
        F.filter(blocks, lambda b: b.contains("<CNTNTS_CL_NM><![CDATA[") & b.contains("<CNTNTS_CL_CN><![CDATA[")),
        lambda b: F.struct(inside(b, "CNTNTS_CL_NM").alias("name"), T.strip(F.regexp_replace(inside(b, "CNTNTS_CL_CN"), r"(?U)\s+", " ")).alias("text")),
    )
    out = df.withColumn("title", inside(F.col(column), "CNTNTS_SJ"))
    out = out.withColumn("sections", F.filter(made, lambda s: ~s["name"].isin(*T.SKIPPED_SECTIONS) & (s["text"] != ""))).drop(column)
    return out.withColumn("body", F.array_join(F.transform("sections", lambda s: F.concat(s["name"], F.lit("\n"), s["text"])), "\n\n"))
