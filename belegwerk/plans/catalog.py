"""Registered queries and the SQL that states the same rows.

The tables stand in for the data of a knowledge service: documents are its documents, chunks are
made from them, benchmark passages are questions, conversations hold questions and answers,
embeddings are chunk vectors whose label is their document, pages are articles in markup, and
events are citations and feedback.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import DEFAULT, KOREAN, PROSE
from ..functions import text as T
from ..operators import accounting, answers, ask, chunking, dense, evaluate, graph, lexical, scores, search
from ..sources import articles, documents, feedback
from .store import spread, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bodies(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.col("text").alias("body"))


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with cidx, their place in the order of documents and chunks."""
    return _placed(bodies(spark, sf))


def _spread_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks written to be walked through."""
    return written(_placed(spread(bodies(spark, sf))).select("cidx", "doc_id", "text"), "chunks")


def _placed(docs: DataFrame) -> DataFrame:
    out = chunking.chunk_documents(docs)
    return out.withColumn("cidx", F.struct("doc_id", "i"))


def _named(rows: DataFrame) -> DataFrame:
    """Rows whose cidx is a chunk's place, with the chunk's name instead; others as they are."""
    if not isinstance(rows.schema["cidx"].dataType, StructType):
        return rows
    return rows.withColumn("chunk_id", F.concat_ws("--", "cidx.doc_id", "cidx.i")).drop("cidx")


# -- SQL building blocks --------------------------------------------------------------------
_WS = r"[\s\p{Z}\x0b\x{85}]"
PROSE_MARKS = r"[\s\x0b\x1c-\x1f]"
_STRIP = lambda x: f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"
_TOKENS = lambda x: f"list_filter(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}_]+'), lambda t: length(t) > 1)"
_SENTENCES = lambda x: (
    f"list_filter(list_transform(string_split(regexp_replace({_STRIP(x)}, '([.다요]){_WS}+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {_STRIP('s')}), lambda s: s <> '')"
)
_CLAIMS = lambda x: (
    f"list_filter(list_transform(string_split(regexp_replace(regexp_replace({_STRIP(x)}, '([.다요]){_WS}+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)), "
    f"lambda s: {_STRIP('s')}), lambda s: length(s) > 4)"
)
_COUNT = lambda x, m: f"((length({x}) - length(replace({x}, '{m}', ''))) // {len(m)})"
_SUM = lambda x, ms: "(" + " + ".join(_COUNT(x, m) for m in ms) + ")"
_POLARITY = lambda x, lex=PROSE: f"CAST(sign({_SUM(x, lex.positive)} - {_SUM(x, lex.negative)}) AS INTEGER)"
_RFIND = lambda m: f"(CASE WHEN strpos(reverse(w), reverse({m})) = 0 THEN -1 ELSE length(w) - strpos(reverse(w), reverse({m})) - {{n}} + 1 END)"
_BOUND = rf"(?s)^.*?(?:(?:다\.|요\.|\.){_WS}|\n{_WS}*\n)"

_CHUNKS = rf"""
d AS (SELECT doc_id, text AS body, length(text) AS n FROM documents),
c AS (
  SELECT doc_id, body, n, 0 AS step, 0 AS pos, 0 AS stop, 0 AS nxt, true AS first FROM d WHERE n > 0
  UNION ALL
  SELECT doc_id, body, n, step + 1, pos, stop,
         CASE WHEN m2 > 0 THEN lo + m2 ELSE stop END, false
  FROM (
    SELECT *, greatest(stop - 80, pos + 1) AS lo,
      length(regexp_extract(substr(body, CAST(greatest(stop - 80, pos + 1) + 1 AS INTEGER), CAST(stop - greatest(stop - 80, pos + 1) AS INTEGER)), '{_BOUND}')) AS m2
    FROM (
      SELECT doc_id, body, n, step, pos,
        CASE WHEN pos + 400 >= n THEN n WHEN cut > 200 THEN pos + cut + 2 ELSE pos + 400 + ext END AS stop
      FROM (
        SELECT *, greatest({_RFIND("(chr(10) || chr(10))").format(n=2)}, {_RFIND("'다.'").format(n=2)}, {_RFIND("'. '").format(n=2)}) AS cut,
          length(regexp_extract(substr(body, CAST(pos + 401 AS INTEGER), 400), '{_BOUND}')) AS ext
        FROM (SELECT doc_id, body, n, step, nxt AS pos, substr(body, CAST(nxt + 1 AS INTEGER), 400) AS w FROM c WHERE first OR stop < n))))
),
chunks AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY step) - 1 AS i, pos AS start, stop AS "end", text
  FROM (SELECT *, {_STRIP('substr(body, CAST(pos + 1 AS INTEGER), CAST(stop - pos AS INTEGER))')} AS text FROM c WHERE NOT first) WHERE text <> '')"""
_NAME = "(cidx // 1000000) || '--' || (cidx % 1000000) AS chunk_id"
_BM25 = rf"""
ws AS MATERIALIZED (SELECT doc_id * 1000000 + i AS cidx, {_TOKENS('text')} AS t FROM chunks),
p AS MATERIALIZED (SELECT cidx, dl, term, count(*) AS tf FROM (SELECT cidx, len(t) AS dl, unnest(t) AS term FROM ws) GROUP BY 1, 2, 3),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM ws),
tr AS MATERIALIZED (SELECT term, count(*) AS df, ln(any_value(st.n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, st GROUP BY term),
tm AS MATERIALIZED (SELECT avg(raw) AS mean FROM tr),
te AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM tr, tm),
q AS (SELECT item_id AS query_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TOKENS('text')}) AS term FROM benchmark) GROUP BY 1, 2),
sc AS (
  SELECT query_id, cidx, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25
  FROM q JOIN te USING (term) JOIN p USING (term), st GROUP BY 1, 2)"""


# -- text ------------------------------------------------------------------------------------
def _lines() -> str:
    page, junk = r"^[-–—\s]*\d{1,3}[-–—\s]*$", r"^\s*(?:https?://\S+|\S*(?:fileDown|FileDown|healthInfoFileDown)\S*|\S*\?SEQ=\S*)\s*$"
    kept = f"list_filter(string_split(regexp_replace(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', ' ', 'g'), chr(10)), lambda x: NOT regexp_matches({_STRIP('x')}, '{page}') AND NOT regexp_matches({_STRIP('x')}, '{junk}'))"
    joined = f"array_to_string(list_transform({kept}, lambda x: regexp_replace(x, '{_WS}+$', '')), chr(10))"
    return _STRIP(f"regexp_replace(regexp_replace({joined}, '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')")


@query("clean_text", f"SELECT doc_id, {_lines()} AS body FROM documents")
def clean_text(spark, sf):
    return bodies(spark, sf).select("doc_id", T.clean_extracted(F.col("body")).alias("body"))


@query("split_sentences", f"SELECT doc_id, CAST(unnest(range(len(s))) AS INTEGER) AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {_SENTENCES('text')} AS s FROM documents)")
def split_sentences(spark, sf):
    return bodies(spark, sf).select("doc_id", F.posexplode(T.split_sentences(F.col("body"))).alias("pos", "sentence"))


@query("split_claims", f"SELECT doc_id, CAST(unnest(range(len(s))) AS INTEGER) AS pos, unnest(s) AS claim FROM (SELECT doc_id, {_CLAIMS('text')} AS s FROM documents)")
def split_claims(spark, sf):
    return bodies(spark, sf).select("doc_id", F.posexplode(T.split_claims(F.col("body"))).alias("pos", "claim"))


_PARAGRAPHS = f"list_filter(list_transform(string_split(regexp_replace(text, '\\n{_WS}*\\n', chr(10), 'g'), chr(10)), lambda p: {_STRIP('p')}), lambda p: p <> '' AND (length(p) >= 20 OR regexp_matches(p, '[.다요]$')))"
_CLEAN = f"flatten(list_transform({_PARAGRAPHS}, lambda p: {_SENTENCES('p')}))"
_GOOD = rf"length(s) >= 12 AND regexp_matches(s, '(?:다|요|음|임)[.!?]?$|[.!?]$') AND NOT regexp_matches(s, '^(?:[,)\]·•]|고,|며,|서,|은|는|을|를|이|가){_WS}')"


@query("clean_sentences", f"SELECT doc_id, s AS sentence, count(*) AS n FROM (SELECT doc_id, unnest({_CLEAN}) AS s FROM documents) GROUP BY 1, 2")
def clean_sentences(spark, sf):
    return bodies(spark, sf).select("doc_id", F.explode(T.clean_sentences(F.col("body"))).alias("sentence")).groupBy("doc_id", "sentence").agg(F.count("*").alias("n"))


@query("wellformed_sentences", f"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest({_CLEAN}) AS s FROM documents) WHERE {_GOOD} GROUP BY 1")
def wellformed_sentences(spark, sf):
    return bodies(spark, sf).select("doc_id", F.explode(T.clean_sentences(F.col("body"), True)).alias("s")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("tokenize", f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, md5(array_to_string(t, ' ')) AS digest FROM (SELECT doc_id, {_TOKENS('text')} AS t FROM documents)")
def tokenize(spark, sf):
    t = bodies(spark, sf).select("doc_id", T.tokens(F.col("body")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("content_tokens", f"SELECT doc_id, CAST(len(list_distinct({_TOKENS('text')})) AS BIGINT) AS n_tokens FROM documents")
def content_tokens(spark, sf):
    return bodies(spark, sf).select("doc_id", F.size(T.content_tokens(F.col("body"))).cast("long").alias("n_tokens"))


@query("safe_name", rf"""SELECT page_id, left(regexp_replace({_STRIP("regexp_replace(url, '[\\/:*?\"<>|]+', '', 'g')")}, '{_WS}+', '_', 'g'), 40) AS name FROM pages""")
def safe_name(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.safe_name(F.col("url")).alias("name"))


@query("polarity", f"SELECT doc_id, {_POLARITY('text')} AS polarity FROM documents")
def polarity(spark, sf):
    return bodies(spark, sf).select("doc_id", T.polarity(F.col("body"), PROSE).alias("polarity"))


@query("advisory_flag", "SELECT conv_id, turn, " + " OR ".join(f"contains(text, '{h}')" for h in PROSE.advisory) + " AS advisory FROM conversations")
def advisory_flag(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.is_advisory(F.col("text"), PROSE).alias("advisory"))


_LICENSE = r"(?im)^[^\n]*(?:licen[sc]e|all rights|cc by)[^\n]*"  # from line starts only: linear
_CLASS = lambda s: f"CASE WHEN trim({s}) = '' OR lower(trim({s})) = 'unknown' THEN 'unknown' WHEN contains(lower({s}), 'all rights') THEN 'arr' WHEN contains({s}, '변경금지') OR contains(lower({s}), '-nd') THEN 'nd' WHEN contains({s}, '공공누리') OR contains({s}, '출처표시') OR contains(lower({s}), 'cc') THEN 'open' ELSE 'unknown' END"


@query("license_class", f"SELECT doc_id, l AS license, {_CLASS('l')} AS lic_class, {_CLASS('l')} = 'open' AS rewrite FROM (SELECT doc_id, regexp_extract(text, '{_LICENSE}') AS l FROM documents)")
def license_class(spark, sf):
    out = bodies(spark, sf).select("doc_id", F.regexp_extract("body", "(?d)" + _LICENSE, 0).alias("license")).withColumn("lic_class", T.license_class(F.col("license")))
    return out.withColumn("rewrite", T.allow_rewrite(F.col("lic_class")))


# -- chunks and lexical retrieval -------------------------------------------------------------
@query("chunk_documents", f'WITH RECURSIVE {_CHUNKS} SELECT doc_id || \'--\' || i AS chunk_id, doc_id, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", md5(text) AS digest FROM chunks')
def chunk_documents(spark, sf):
    return chunks(spark, sf).select("chunk_id", "doc_id", "start", "end", F.md5("text").alias("digest"))


@query("chunk_stats", f'WITH RECURSIVE {_CHUNKS} SELECT doc_id, count(*) AS n_chunks, CAST(max("end" - start) AS INTEGER) AS longest, CAST(min(start) AS INTEGER) AS first FROM chunks GROUP BY doc_id')
def chunk_stats(spark, sf):
    return chunks(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max(F.col("end") - F.col("start")).alias("longest"), F.min("start").alias("first"))


@query("source_slice", f'WITH RECURSIVE {_CHUNKS} SELECT k.doc_id || \'--\' || i AS chunk_id, k.doc_id, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", substr(body, CAST(start + 1 AS INTEGER), CAST("end" - start AS INTEGER)) AS passage FROM chunks k JOIN d ON d.doc_id = k.doc_id')
def source_slice(spark, sf):
    return chunking.source_slice(chunks(spark, sf), bodies(spark, sf))


@query("term_stats", f"WITH RECURSIVE {_CHUNKS}, {_BM25} SELECT term, df, round(idf, 6) AS idf FROM te")
def term_stats(spark, sf):
    index = lexical.build_index(chunks(spark, sf))
    return index.terms.select("term", "df", F.round("idf", 6).alias("idf"))


def _bm25(spark, sf, matched: bool = True):
    """The best chunks of each question by BM25 to 6 places, those only that share a term if ``matched``."""
    all_chunks = _spread_chunks(spark, sf)
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    known = scores.vocabulary(all_chunks, dense=False)
    best = scores.best(all_chunks, asked, known, DEFAULT.pool, ("bm25",), places=6, matched=matched).select("query_id", "cidx", F.round("bm25", 6).alias("bm25"))
    return lexical.top_ranked(best, "bm25", DEFAULT.pool, "rank")


@query("bm25_topk", f"WITH RECURSIVE {_CHUNKS}, {_BM25} SELECT query_id, {_NAME}, bm25, rank FROM (SELECT query_id, cidx, round(bm25, 6) AS bm25, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, cidx) AS INTEGER) AS rank FROM sc) WHERE rank <= 4")
def bm25_topk(spark, sf):
    return _named(_bm25(spark, sf))


@query("bm25_zero_fill", f"WITH RECURSIVE {_CHUNKS}, {_BM25}, f AS (SELECT b.item_id AS query_id, ws.cidx, round(coalesce(bm25, 0), 6) AS bm25 FROM benchmark b CROSS JOIN ws LEFT JOIN sc ON sc.query_id = b.item_id AND sc.cidx = ws.cidx) SELECT query_id, {_NAME}, bm25, rank FROM (SELECT query_id, cidx, bm25, CAST(row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, cidx) AS INTEGER) AS rank FROM f) WHERE rank <= 4")
def bm25_zero_fill(spark, sf):
    return _named(_bm25(spark, sf, matched=False))


# -- dense retrieval ---------------------------------------------------------------------------
@query("cosine_topk", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS cidx, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) AS x
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT query_id, cidx, round(x, 5) AS dense, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY x DESC, cidx) AS INTEGER) AS rank FROM s) WHERE rank <= 4""")
def cosine_topk(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("own"), dense.normalised(F.col("embedding")).alias("v"))
    return dense.block_top_k(rows.where("id % 100 = 0"), rows, DEFAULT.pool).withColumn("dense", F.round("dense", 5))


@query("indexed_topk")
def indexed_topk(spark, sf):
    """The nearest vectors by an inverted file, for every hundredth row; recall is in the tests."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("own"), dense.normalised(F.col("embedding")).alias("v"))
    return dense.indexed_top_k(rows.where("id % 100 = 0"), rows, DEFAULT.pool).withColumn("dense", F.round("dense", 5))


_GRAMS = lambda x: f"flatten(list_transform(list_filter(string_split(regexp_replace(lower({x}), '{_WS}+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: flatten([list_transform(range(1, greatest(length(w) + 2 - 2 + 1, 1) + 1), lambda i: substr(' ' || w || ' ', CAST(i AS INTEGER), 2)), list_transform(range(1, greatest(length(w) + 2 - 3 + 1, 1) + 1), lambda i: substr(' ' || w || ' ', CAST(i AS INTEGER), 3)), CASE WHEN length(w) + 2 > 3 THEN list_transform(range(1, length(w) + 2 - 4 + 2), lambda i: substr(' ' || w || ' ', CAST(i AS INTEGER), 4)) ELSE [] END])))"
_TURNS = "SELECT conv_id || '-' || turn AS query_id, text FROM conversations WHERE role = 'user'"
_DENSE = f"""
b AS (SELECT item_id AS cidx, text FROM benchmark), u AS ({_TURNS}),
g AS (SELECT cidx, gram, count(*) AS tf FROM (SELECT cidx, unnest({_GRAMS('text')}) AS gram FROM b) GROUP BY 1, 2),
i AS (SELECT gram, ln((1 + (SELECT count(*) FROM b)) / (1 + df)) + 1 AS idf FROM (SELECT gram, sum(tf) AS cf, count(*) AS df FROM g GROUP BY 1 ORDER BY cf DESC, gram LIMIT 50000)),
r AS (SELECT cidx, gram, tf * idf AS w FROM g JOIN i USING (gram)), n AS (SELECT cidx, sqrt(sum(w * w)) AS n FROM r GROUP BY 1),
x AS (SELECT cidx, gram, w / n AS w FROM r JOIN n USING (cidx)),
h AS (SELECT query_id, gram, count(*) AS tf FROM (SELECT query_id, unnest({_GRAMS('text')}) AS gram FROM u) GROUP BY 1, 2),
hr AS (SELECT query_id, gram, tf * idf AS w FROM h JOIN i USING (gram)), hn AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM hr GROUP BY 1),
y AS (SELECT query_id, gram, w / n AS w FROM hr JOIN hn USING (query_id)),
ds AS (SELECT query_id, cidx, sum(x.w * y.w) AS dense FROM x JOIN y USING (gram) GROUP BY 1, 2)"""


def _small(spark, sf):
    """Benchmark passages as chunks (a document for every four) and user turns as questions."""
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("cidx"), F.call_function("div", "item_id", F.lit(4)).alias("doc_id"), "text")
    u = table(spark, sf, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), "text")
    return b, u


def _whole(spark, sf):
    """Chunks of all documents, and benchmark passages as questions."""
    return _spread_chunks(spark, sf), table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


@query("tfidf_charwb_topk", f"WITH {_DENSE} SELECT * FROM (SELECT query_id, cidx, round(dense, 6) AS dense, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(dense, 6) DESC, cidx) AS INTEGER) AS rank FROM ds) WHERE rank <= 4")
def tfidf_charwb_topk(spark, sf, corpus=_small):
    b, u = corpus(spark, sf)
    best = scores.best(b, u, scores.vocabulary(b, lexical=False), DEFAULT.pool, ("dense",), places=6, matched=True)
    return _named(lexical.top_ranked(best.select("query_id", "cidx", F.round("dense", 6).alias("dense")), "dense", DEFAULT.pool, "rank"))


_LEX = f"""
ws AS (SELECT cidx, {_TOKENS('text')} AS t FROM b),
p AS (SELECT cidx, dl, term, count(*) AS tf FROM (SELECT cidx, len(t) AS dl, unnest(t) AS term FROM ws) GROUP BY 1, 2, 3),
st AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM ws),
tr AS (SELECT term, count(*) AS df, ln(any_value(st.n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM p, st GROUP BY term),
te AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM tr) ELSE raw END AS idf FROM tr),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({_TOKENS('text')}) AS term FROM u) GROUP BY 1, 2),
ls AS (SELECT query_id, cidx, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS bm25 FROM q JOIN te USING (term) JOIN p USING (term), st GROUP BY 1, 2)"""


def _hybrid(off: str = "") -> str:
    on = f"WHERE b.cidx // 4 NOT IN ({off})" if off else ""
    return f"""
fu AS (SELECT u.query_id, b.cidx, coalesce(dense, 0) AS dense, coalesce(bm25, 0) AS bm25 FROM u CROSS JOIN b
       LEFT JOIN ds ON ds.query_id = u.query_id AND ds.cidx = b.cidx LEFT JOIN ls ON ls.query_id = u.query_id AND ls.cidx = b.cidx {on}),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense DESC, cidx) AS dr, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, cidx) AS br FROM fu),
po AS (SELECT *, CASE WHEN dr <= 4 THEN 1.0::DOUBLE / (60 + dr) ELSE 0 END + CASE WHEN br <= 4 THEN 1.0::DOUBLE / (60 + br) ELSE 0 END AS fused FROM rk WHERE dr <= 4 OR br <= 4),
fr AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, CASE WHEN dr <= 4 THEN dr END NULLS LAST, CASE WHEN br <= 4 THEN br END NULLS LAST) AS INTEGER) AS rank FROM po),
hits AS (SELECT query_id, rank, cidx, cidx // 4 AS doc_id, dense, bm25, fused FROM fr WHERE rank <= 4)"""


_HITS = "SELECT query_id, rank, cidx, doc_id, round(dense, 6) AS score, round(bm25, 6) AS bm25_score, round(fused, 9) AS fused_score FROM hits"
_SIGNALS = "sg AS (SELECT u.query_id, coalesce(max(fu.dense), 0) AS dense_top, coalesce(max(fu.bm25), 0) AS bm25_top, count(fu.cidx) AS n FROM u LEFT JOIN fu ON fu.query_id = u.query_id GROUP BY 1)"


def _hits(hits: DataFrame) -> DataFrame:
    out = hits.select("query_id", "rank", "cidx", "doc_id", F.round("score", 6).alias("score"), F.round("bm25_score", 6).alias("bm25_score"), F.round("fused_score", 9).alias("fused_score"))
    return _named(out)


@query("hybrid_search", f"WITH {_DENSE}, {_LEX}, {_hybrid()} {_HITS}")
def hybrid_search(spark, sf, corpus=_small):
    return _hits(search.hybrid_search(*corpus(spark, sf))[0])


@query("rrf_fuse", f"WITH {_DENSE}, {_LEX}, {_hybrid()} SELECT query_id, cidx, round(fused, 9) AS fused, CAST(CASE WHEN dr <= 4 THEN dr END AS INTEGER) AS dense_rank, CAST(CASE WHEN br <= 4 THEN br END AS INTEGER) AS bm25_rank, rank AS fused_rank FROM fr")
def rrf_fuse(spark, sf, corpus=_small):
    b, u = corpus(spark, sf)
    best = written(scores.best(b, u, scores.vocabulary(b), DEFAULT.pool), "scores")
    d, x = (lexical.top_ranked(best.withColumn("place", F.round(c, scores.PLACES)), "place", DEFAULT.pool, "rank") for c in ("dense", "bm25"))
    out = search.rrf_fuse(d, x)
    return _named(out.withColumn("fused", F.round("fused", 9)))


def _off(spark, sf, corpus=_small) -> DataFrame:
    docs = table(spark, sf, "benchmark").select(F.call_function("div", "item_id", F.lit(4)).alias("doc_id")) if corpus is _small else bodies(spark, sf).select("doc_id")
    return docs.where("doc_id % 3 = 0").distinct()


@query("search_excluding_sources", f"WITH {_DENSE}, {_LEX}, {_hybrid('SELECT DISTINCT item_id // 4 FROM benchmark WHERE item_id // 4 % 3 = 0')} {_HITS}")
def search_excluding_sources(spark, sf, corpus=_small):
    return _hits(search.hybrid_search(*corpus(spark, sf), disabled=_off(spark, sf, corpus))[0])


@query("query_signals", f"WITH {_DENSE}, {_LEX}, {_hybrid()}, {_SIGNALS} SELECT query_id, round(dense_top, 6) AS dense_top, round(bm25_top, 6) AS bm25_top, CAST(least(n, 4) AS BIGINT) > 0 AS has_hits FROM sg")
def query_signals(spark, sf, corpus=_small):
    s = search.hybrid_search(*corpus(spark, sf))[1]
    return s.select("query_id", F.round("dense_top", 6).alias("dense_top"), F.round("bm25_top", 6).alias("bm25_top"), (F.col("n_hits") > 0).alias("has_hits"))


@query("refusal_decision", f"WITH {_DENSE}, {_LEX}, {_hybrid()}, {_SIGNALS} SELECT query_id, n = 0 OR bm25_top <= 0 AS refused, n = 0 OR dense_top < 0.06 AS refused_dense FROM sg")
def refusal_decision(spark, sf, corpus=_small):
    s = search.hybrid_search(*corpus(spark, sf))[1]
    return s.select("query_id", search.refused().alias("refused"), search.refused(bm25_available=False).alias("refused_dense"))


#: Markers by which claims of the invented prose are opposed to each other.
_SIDES = replace(PROSE, negative=("on", "es"), positive=("th", "en", "er"))

_SIM = lambda a, b: f"len(list_intersect(list_distinct({_TOKENS(a)}), list_distinct({_TOKENS(b)}))) / sqrt(greatest(len(list_distinct({_TOKENS(a)})), 1) * greatest(len(list_distinct({_TOKENS(b)})), 1)::DOUBLE)"


# -- evidence, answers, verification -------------------------------------------------------------
_META = f"m AS (SELECT DISTINCT item_id // 4 AS doc_id, 'Title ' || (item_id // 4) AS title, CASE WHEN (item_id // 4) % 2 = 0 THEN 'CC BY 4.0' ELSE 'All rights reserved' END AS license FROM benchmark)"


def _meta(spark, sf, corpus=_small) -> DataFrame:
    if corpus is not _small:
        line = F.regexp_extract("text", "(?d)" + _LICENSE, 0).alias("license")
        return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("Document "), "doc_id").alias("title"), F.col("source").alias("publisher"), F.lit(None).cast("string").alias("year"), line)
    d = table(spark, sf, "benchmark").select(F.call_function("div", "item_id", F.lit(4)).alias("doc_id")).distinct()
    return d.select(
        "doc_id", F.concat(F.lit("Title "), "doc_id").alias("title"), F.lit("p").alias("publisher"), F.lit("2024").alias("year"),
        F.when(F.col("doc_id") % 2 == 0, "CC BY 4.0").otherwise("All rights reserved").alias("license"),
    )


def _evidence(spark, sf, corpus=_small) -> DataFrame:
    return answers.evidence_payload(search.hybrid_search(*corpus(spark, sf))[0], _meta(spark, sf, corpus))


@query("evidence_payload", f"WITH {_DENSE}, {_LEX}, {_hybrid()}, {_META} SELECT query_id, rank, cidx, title, license, {_CLASS('license')} AS lic_class FROM hits JOIN m USING (doc_id)")
def evidence_payload(spark, sf, corpus=_small):
    return _named(_evidence(spark, sf, corpus).select("query_id", "rank", "cidx", "title", "license", "lic_class"))


@query("numbered_evidence", f"WITH {_DENSE}, {_LEX}, {_hybrid()}, {_META} SELECT query_id, string_agg('[' || rank || '] (' || title || ')' || CASE WHEN {_CLASS('license')} = 'open' THEN '' ELSE '〔원문 그대로만 인용〕' END || ' ' || b.text, chr(10) ORDER BY rank) AS prompt FROM hits JOIN m USING (doc_id) JOIN b ON b.cidx = hits.cidx GROUP BY 1")
def numbered_evidence(spark, sf, corpus=_small):
    return answers.numbered_evidence(_evidence(spark, sf, corpus))


_EXTRACT = f"""
tp AS (SELECT query_id, doc_id AS top FROM hits WHERE rank = 1),
cs AS (SELECT h.query_id, h.rank, unnest(range(len(c))) AS pos, unnest(c) AS s
       FROM (SELECT hits.query_id, hits.rank, {_CLEAN.replace('text', 'b.text')} AS c FROM hits JOIN tp ON tp.query_id = hits.query_id AND tp.top = hits.doc_id JOIN b ON b.cidx = hits.cidx) h),
wf AS (SELECT *, {_GOOD} AS good FROM cs WHERE length(s) > 15),
us AS (SELECT * FROM wf WHERE good OR query_id NOT IN (SELECT query_id FROM wf WHERE good)),
un AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, regexp_replace(s, '{_WS}+', '', 'g') ORDER BY rank, pos) AS rn FROM us) WHERE rn = 1),
sm AS (SELECT un.*, {_SIM('u.text', 's')} AS sim FROM un JOIN u ON u.query_id = un.query_id),
bt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, rank, pos) AS bn FROM sm) WHERE bn <= 3),
ex AS (SELECT query_id, list({{'text': s, 'citations': [rank]}} ORDER BY rank, pos) AS ss FROM bt GROUP BY 1)"""


@query("extractive_answer", f"""WITH {_DENSE}, {_LEX}, {_hybrid()}, {_EXTRACT},
ad AS (SELECT query_id, CASE WHEN len(list_filter(ss, lambda x: contains(x.text, '{PROSE.advisory[0]}'))) > 0 THEN ss ELSE list_append(ss, {{'text': '{PROSE.advice}', 'citations': []}}) END AS ss FROM ex)
SELECT query_id, CAST(len(ss) AS INTEGER) AS n, array_to_string(list_transform(ss, lambda x: x.text || array_to_string(list_transform(x.citations, lambda c: '[' || c || ']'), '')), ' ') AS answer FROM ad""")
def extractive_answer(spark, sf, corpus=_small):
    b, u = corpus(spark, sf)
    found = answers.extractive_answer(search.hybrid_search(b, u)[0], u, answers.token_overlap)
    return answers.with_advice(found, PROSE).select("query_id", F.size("sentences").alias("n"), "answer")


def _model(asked: DataFrame) -> DataFrame:
    """A stand-in for a language model, by the length of its prompt: JSON, text with marks, no
    sentences, or a failure."""
    kind = F.length("prompt") % 4
    text = F.when(kind == 0, '{"sentences": [{"text": "First.", "citations": [1, 9]}, {"text": "Rest with it.", "citations": []}]}').when(kind == 1, "One thing.[2] Another.[7]").when(kind == 2, '{"sentences": []}')
    return asked.select("query_id", text.alias("text"))


@query("generate_answer", f"""WITH {_DENSE}, {_LEX}, {_hybrid()}, {_META}, {_EXTRACT},
ev AS (SELECT query_id, string_agg('[' || rank || '] (' || title || ')' || CASE WHEN {_CLASS('license')} = 'open' THEN '' ELSE '〔원문 그대로만 인용〕' END || ' ' || b.text, chr(10) ORDER BY rank) AS prompt FROM hits JOIN m USING (doc_id) JOIN b ON b.cidx = hits.cidx GROUP BY 1),
kd AS (SELECT ev.query_id, (length(prompt) + length(u.text) + {len(answers.PROMPT) - len('{evidence}') - len('{question}')}) % 4 AS kind FROM ev JOIN u ON u.query_id = ev.query_id),
xa AS (SELECT query_id, CASE WHEN len(list_filter(ss, lambda x: contains(x.text, '{PROSE.advisory[0]}'))) > 0 THEN ss ELSE list_append(ss, {{'text': '{PROSE.advice}', 'citations': []}}) END AS ss FROM ex)
SELECT kd.query_id, CASE WHEN kind < 3 THEN 'llm' ELSE 'extractive' END AS mode, CASE kind WHEN 0 THEN 'First.[1] Rest with it.' WHEN 1 THEN 'One thing. Another.[2] {PROSE.advice}' WHEN 2 THEN '{T.NO_EVIDENCE}'
  ELSE coalesce(array_to_string(list_transform(ss, lambda x: x.text || array_to_string(list_transform(x.citations, lambda c: '[' || c || ']'), '')), ' '), '{T.NO_EVIDENCE}') END AS answer
FROM kd LEFT JOIN xa ON xa.query_id = kd.query_id""")
def generate_answer(spark, sf, corpus=_small):
    _, u = corpus(spark, sf)
    made = answers.generate(_evidence(spark, sf, corpus), u, _model, answers.token_overlap, PROSE)
    return made.select("query_id", "mode", "answer")


def _marked(spark, sf) -> DataFrame:
    """Assistant turns with a citation mark after each sentence, numbered by its length."""
    a = table(spark, sf, "conversations").where("role = 'assistant'")
    return a.select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), F.regexp_replace("text", r"\. ", F.lit(".[2] ")).alias("text"))


_MARKED = r"a AS (SELECT conv_id || '-' || turn AS query_id, regexp_replace(text, '\. ', '.[2] ', 'g') AS text FROM conversations WHERE role = 'assistant')"
_PARSED = f"s AS (SELECT query_id, unnest(range(len(p))) AS sidx, unnest(p) AS raw FROM (SELECT query_id, {_SENTENCES('text')} AS p FROM a)), pc AS (SELECT query_id, sidx, {_STRIP(chr(39).join(['regexp_replace(raw, ', chr(92)+'['+chr(92)+'d+'+chr(92)+']', ', ', '', ', ', 'g', ')']))} AS text, len(list_distinct(list_filter(list_transform(regexp_extract_all(raw, '\\[(\\d+)\\]', 1), lambda x: CAST(x AS INTEGER)), lambda x: x BETWEEN 1 AND 4))) AS n FROM s)"


@query("parse_citations", f"WITH {_MARKED}, {_PARSED} SELECT query_id, count(*) AS n_sentences, CAST(sum(n) AS BIGINT) AS n_cites, md5(string_agg(text, '|' ORDER BY sidx)) AS digest FROM pc WHERE text <> '' GROUP BY 1")
def parse_citations(spark, sf):
    s = _marked(spark, sf).select("query_id", T.parse_citations(F.col("text"), 4).alias("s")).where(F.size("s") > 0)
    cites = F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + F.size(x["citations"]))
    return s.select("query_id", F.size("s").cast("long").alias("n_sentences"), cites.alias("n_cites"), F.md5(F.array_join(F.transform("s", lambda x: x["text"]), "|")).alias("digest"))


@query("render_answer", f"WITH {_MARKED}, {_PARSED} SELECT query_id, string_agg(text || CASE WHEN n > 0 THEN '[2]' ELSE '' END, ' ' ORDER BY sidx) AS answer FROM pc WHERE text <> '' GROUP BY 1")
def render_answer(spark, sf):
    s = _marked(spark, sf).select("query_id", T.parse_citations(F.col("text"), 4).alias("s")).where(F.size("s") > 0)
    return s.select("query_id", T.render(F.col("s")).alias("answer"))


_JSON = f"""
SELECT conv_id || '-' || turn AS query_id,
  CASE turn % 5 WHEN 1 THEN 0 WHEN 2 THEN NULL WHEN 4 THEN NULL ELSE CASE WHEN text = '' THEN 0 ELSE 1 END END AS n,
  CASE WHEN turn % 5 IN (0, 3) AND text <> '' THEN {_STRIP('text')} END AS text
FROM (SELECT conv_id, turn, coalesce(text, '') || CASE WHEN turn % 2 = 0 THEN ' {{{{x}}}} ' ELSE '' END AS text FROM conversations)"""


@query("parse_llm_json", _JSON.replace("{{", "{").replace("}}", "}"))
def parse_llm_json(spark, sf):
    """Turns as answers of a model: fenced JSON, JSON without sentences, no JSON, JSON within prose,
    and JSON that breaks off. Texts may be blank and hold braces."""
    braces = F.when(F.col("turn") % 2 == 0, " {x} ").otherwise("")
    a = table(spark, sf, "conversations").withColumn("text", F.concat(F.coalesce("text", F.lit("")), braces))
    body = F.to_json(F.struct(F.array(F.struct("text", F.array(F.lit("1"), F.lit("9")).alias("citations"))).alias("sentences")))
    kind = F.col("turn") % 5
    raw = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == 1, '{"sentences": []}')
        .when(kind == 2, "no json")
        .when(kind == 3, F.concat(F.lit("Here it is:\n"), body, F.lit("\nas asked.")))
        .otherwise(F.concat(F.lit('{"sentences": ['), F.left(body, F.lit(20))))
    )
    s = a.select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), T.parse_llm_json(raw, 4).alias("s"))
    return s.select("query_id", F.when(F.col("s").isNotNull(), F.size("s")).alias("n"), F.try_element_at("s", F.lit(1))["text"].alias("text"))


def _sentences(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Answers to verify: the sentences of each benchmark passage, each citing the passage itself
    and the next one; every fifth cites nothing."""
    b = table(spark, sf, "benchmark")
    s = b.select(F.col("item_id").alias("query_id"), F.posexplode(T.split_sentences(F.col("text"))).alias("sidx", "text"))
    none = (F.col("query_id") + F.col("sidx")) % 5 == 4
    cites = F.when(none, F.array().cast("array<int>")).otherwise(F.array(F.lit(1), F.lit(2)))
    own = b.select(F.col("item_id").alias("query_id"), F.lit(1).alias("rank"), F.col("item_id").alias("doc_id"), "text")
    after = b.select((F.col("item_id") - 1).alias("query_id"), F.lit(2).alias("rank"), F.col("item_id").alias("doc_id"), "text")
    return s.select("query_id", "sidx", "text", cites.alias("citations")), own.union(after)


_VERIFY = f"""
ev AS (SELECT item_id AS query_id, 1 AS rank, item_id AS doc_id, text FROM benchmark UNION ALL SELECT item_id - 1, 2, item_id, text FROM benchmark),
s0 AS (SELECT item_id AS query_id, unnest(range(len(p))) AS sidx, unnest(p) AS sentence FROM (SELECT item_id, {_SENTENCES('text')} AS p FROM benchmark)),
s AS (SELECT query_id, sidx, sentence, CASE WHEN (query_id + sidx) % 5 = 4 THEN [] ELSE [1, 2] END AS given FROM s0 WHERE length(sentence) >= 8),
c AS (SELECT query_id, sidx, sentence, unnest(given) AS rank FROM s),
pr AS (SELECT c.*, ev.text AS evidence, ev.doc_id, {_SIM('sentence', 'ev.text')} AS sim, contains(regexp_replace(ev.text, '{_WS}+', '', 'g'), regexp_replace(sentence, '{_WS}+', '', 'g')) AS quoted FROM c JOIN ev ON ev.query_id = c.query_id AND ev.rank = c.rank),
cl AS (SELECT query_id, sidx, rank, unnest(range(len(k))) AS pos, unnest(k) AS claim, sentence FROM (SELECT query_id, sidx, rank, sentence, {_CLAIMS('evidence')} AS k FROM pr)),
ov AS (SELECT *, len(list_intersect(list_distinct({_TOKENS('sentence')}), list_distinct({_TOKENS('claim')}))) AS ov FROM cl),
be AS (SELECT *, row_number() OVER (PARTITION BY query_id, sidx, rank ORDER BY ov DESC, pos) AS rn FROM ov WHERE ov > 0),
cf AS (SELECT query_id, sidx, rank, ov >= 2 AND {_POLARITY('sentence')} <> 0 AND {_POLARITY('claim')} <> 0 AND {_POLARITY('sentence')} <> {_POLARITY('claim')} AS conflict FROM be WHERE rn = 1),
jd AS (SELECT pr.query_id, pr.sidx, max(sim) AS sim, bool_or(quoted) AS verbatim, bool_or(coalesce(conflict, false)) AS against FROM pr LEFT JOIN cf ON cf.query_id = pr.query_id AND cf.sidx = pr.sidx AND cf.rank = pr.rank GROUP BY 1, 2),
vr AS (SELECT s.query_id, s.sidx, s.sentence, jd.sim, jd.sidx IS NOT NULL AS cited, coalesce(NOT verbatim AND against, false) AS against, {' OR '.join(f"contains(s.sentence, '{h}')" for h in PROSE.advisory)} AS adv FROM s LEFT JOIN jd ON jd.query_id = s.query_id AND jd.sidx = s.sidx),
rows AS (SELECT query_id, CAST(sidx AS INTEGER) AS sidx, sentence, round(sim, 3) AS similarity, CASE WHEN cited THEN sim < 0.45 OR against ELSE NOT adv END AS warn,
  CASE WHEN cited AND against THEN 'contradiction' WHEN cited THEN 'grounded' WHEN adv THEN 'advisory' ELSE 'uncited' END AS status, against AS contradiction FROM vr)"""


def _verified(spark, sf) -> DataFrame:
    return answers.verify_sentences(*_sentences(spark, sf), lexicon=PROSE)


@query("verify_sentences", f"WITH {_VERIFY} SELECT * FROM rows")
def verify_sentences(spark, sf):
    return _verified(spark, sf).select("query_id", "sidx", "sentence", "similarity", "warn", "status", "contradiction")


@query("verbatim_quote", f"WITH {_VERIFY} SELECT query_id, CAST(sidx AS INTEGER) AS sidx, CAST(rank AS INTEGER) AS rank, quoted FROM pr")
def verbatim_quote(spark, sf):
    s, e = _sentences(spark, sf)
    s = s.where(F.length("text") >= 8).select("query_id", "sidx", "text", F.explode("citations").alias("rank"))
    return s.join(e.select("query_id", "rank", F.col("text").alias("evidence")), ["query_id", "rank"]).select("query_id", "sidx", "rank", T.squash(F.col("evidence")).contains(T.squash(F.col("text"))).alias("quoted"))


@query("negation_conflict", f"WITH {_VERIFY} SELECT pr.query_id, CAST(pr.sidx AS INTEGER) AS sidx, CAST(pr.rank AS INTEGER) AS rank, coalesce(conflict, false) AS conflict FROM pr LEFT JOIN cf ON cf.query_id = pr.query_id AND cf.sidx = pr.sidx AND cf.rank = pr.rank")
def negation_conflict(spark, sf):
    s, e = _sentences(spark, sf)
    s = s.where(F.length("text") >= 8).select("query_id", "sidx", F.col("text").alias("sentence"), F.explode("citations").alias("rank"))
    pairs = s.join(e.select("query_id", "rank", F.col("text").alias("evidence")), ["query_id", "rank"]).withColumn("pair_id", F.struct("query_id", "sidx", "rank"))
    return answers.negation_conflict(pairs, PROSE).select("pair_id.query_id", "pair_id.sidx", "pair_id.rank", "conflict")


@query("source_conflict", f"""
WITH {_DENSE}, {_LEX}, {_hybrid()},
k AS (SELECT query_id, rank, doc_id, unnest(range(len(c))) AS pos, unnest(c) AS claim FROM (SELECT query_id, rank, doc_id, {_CLAIMS('b.text')} AS c FROM hits JOIN b ON b.cidx = hits.cidx)),
kp AS (SELECT *, {_POLARITY('claim', _SIDES)} AS pol, list_distinct({_TOKENS('claim')}) AS toks FROM k),
mt AS (SELECT x.query_id, x.rank AS i, y.rank AS j, x.pos AS p, y.pos AS q, x.claim AS a, y.claim AS c FROM kp x JOIN kp y ON x.query_id = y.query_id AND x.rank < y.rank AND x.doc_id <> y.doc_id AND x.pol <> 0 AND x.pol = -y.pol WHERE len(list_intersect(x.toks, y.toks)) >= 3)
SELECT query_id, i, j, a AS claim_a, c AS claim_b FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i, j, p, q) AS rn FROM mt) WHERE rn = 1""")
def source_conflict(spark, sf, corpus=_small):
    out = answers.source_conflict(search.hybrid_search(*corpus(spark, sf))[0], _SIDES)
    return out.select("query_id", F.col("between")[0].alias("i"), F.col("between")[1].alias("j"), F.col("claims")[0].alias("claim_a"), F.col("claims")[1].alias("claim_b"))


# -- graph ---------------------------------------------------------------------------------------
_DOCS = lambda spark, sf: table(spark, sf, "documents").select("doc_id", F.concat(F.lit("Document "), "doc_id").alias("title"), F.col("source").alias("publisher"), F.lit(None).cast("string").alias("license"), F.lit(None).cast("string").alias("url"))


@query("doc_nodes", f"WITH RECURSIVE {_CHUNKS} SELECT 'doc:' || t.doc_id AS id, 'Document ' || t.doc_id AS label, source AS publisher, count(k.doc_id) AS size FROM documents t LEFT JOIN chunks k ON k.doc_id = t.doc_id GROUP BY t.doc_id, source")
def doc_nodes(spark, sf):
    return graph.doc_nodes(_DOCS(spark, sf), chunks(spark, sf)).select("id", "label", "publisher", "size")


@query("member_edges", f"WITH RECURSIVE {_CHUNKS} SELECT 'doc:' || doc_id AS s, 'chunk:' || doc_id || '--' || i AS t, 'member' AS kind FROM chunks")
def member_edges(spark, sf):
    return graph.member_edges(chunks(spark, sf))


def _vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("cidx"), F.col("label").cast("long").alias("doc_id"), F.col("embedding").alias("v"))


_UNIT = "e AS (SELECT vec_id, CAST(label AS BIGINT) AS doc_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS v FROM embeddings)"
_DOCV = f"{_UNIT}, x AS (SELECT doc_id, unnest(range(len(v))) AS i, unnest(v) AS x FROM e), mn AS (SELECT doc_id, i, avg(x) AS x FROM x GROUP BY 1, 2), nm AS (SELECT doc_id, sqrt(sum(x * x)) AS n FROM mn GROUP BY 1), dv AS (SELECT mn.doc_id, i, x / n AS x FROM mn JOIN nm ON mn.doc_id = nm.doc_id)"
_KNN = lambda src, key: f"top AS (SELECT a, b, w FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS rn FROM ({src})) WHERE rn <= 3) SELECT least(a, b) AS a, greatest(a, b) AS b, round(max(w), 5) AS w FROM top GROUP BY 1, 2"


@query("doc_vectors", f"WITH {_DOCV} SELECT doc_id, i, round(x, 6) AS x FROM dv")
def doc_vectors(spark, sf):
    return graph.doc_vectors(_vectors(spark, sf)).select("doc_id", F.posexplode("v").alias("i", "x")).select("doc_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


@query("doc_knn", f"WITH {_DOCV}, {_KNN('SELECT p.doc_id AS a, q.doc_id AS b, sum(p.x * q.x) AS w FROM dv p JOIN dv q ON p.i = q.i AND p.doc_id <> q.doc_id GROUP BY 1, 2', 'doc_id')}")
def doc_knn(spark, sf):
    return graph.doc_knn(graph.doc_vectors(_vectors(spark, sf))).withColumn("w", F.round("w", 5))


@query("chunk_knn", f"WITH {_UNIT}, {_KNN('SELECT p.vec_id AS a, q.vec_id AS b, list_dot_product(p.v, q.v) AS w FROM e p JOIN e q ON p.doc_id <> q.doc_id', 'vec_id')}")
def chunk_knn(spark, sf):
    return graph.chunk_knn(_vectors(spark, sf)).withColumn("w", F.round("w", 5))


_PARTS = "v AS (SELECT vec_id AS cidx, CAST(label AS BIGINT) AS doc_id, text FROM embeddings JOIN benchmark ON item_id = vec_id)"
_OPPOSED = f"""{_UNIT}, {_PARTS},
k AS (SELECT cidx, doc_id, unnest(range(len(c))) AS pos, unnest(c) AS claim FROM (SELECT cidx, doc_id, {_CLAIMS('text')} AS c FROM v)),
kp AS (SELECT *, {_POLARITY('claim', _SIDES)} AS pol, list_distinct({_TOKENS('claim')}) AS toks FROM k),
cf AS (SELECT DISTINCT x.cidx AS a, y.cidx AS b FROM kp x JOIN kp y ON x.cidx < y.cidx AND x.doc_id <> y.doc_id AND x.pol <> 0 AND x.pol = -y.pol JOIN e ON e.vec_id = x.cidx JOIN e f ON f.vec_id = y.cidx
  WHERE len(list_intersect(x.toks, y.toks)) >= 4 AND list_dot_product(e.v, f.v) >= -0.3)"""


def _parts(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Benchmark passages as chunks of the documents that the labels of their vectors name."""
    v = _vectors(spark, sf).join(table(spark, sf, "benchmark").withColumnRenamed("item_id", "cidx"), "cidx")
    chunk = v.select("cidx", F.concat_ws("--", "doc_id", "cidx").alias("chunk_id"), "doc_id", "text")
    return chunk, v.select("cidx", "doc_id", "v")


@query("conflict_edges", f"WITH {_OPPOSED} SELECT a, b FROM cf")
def conflict_edges(spark, sf):
    chunk, vectors = _parts(spark, sf)
    return graph.conflict_edges(chunk, vectors, _SIDES, settings=replace(DEFAULT, conflict_similarity=-0.3))


_NEAR = _KNN("SELECT p.vec_id AS a, q.vec_id AS b, list_dot_product(p.v, q.v) AS w FROM e p JOIN e q ON p.doc_id <> q.doc_id JOIN v x ON x.cidx = p.vec_id JOIN v y ON y.cidx = q.vec_id", "vec_id")


def _graph(spark, sf, limit: int) -> tuple[DataFrame, DataFrame]:
    chunk, vectors = _parts(spark, sf)
    docs = chunk.select("doc_id").distinct().select("doc_id", F.concat(F.lit("Label "), "doc_id").alias("title"), *[F.lit(None).cast("string").alias(c) for c in ("publisher", "license", "url")])
    return graph.knowledge_graph(docs, chunk, vectors, _SIDES, replace(DEFAULT, graph_limit=limit, conflict_similarity=-0.3))


@query("graph_nodes", f"""
WITH {_PARTS} SELECT 'doc:' || doc_id AS id, 'doc' AS type, 'Label ' || doc_id AS label, count(*) AS size FROM v GROUP BY doc_id
UNION ALL SELECT 'chunk:' || doc_id || '--' || cidx, 'chunk', left(text, 38), NULL FROM v""")
def graph_nodes(spark, sf):
    return _graph(spark, sf, 1_000_000)[0].select("id", "type", "label", "size")


@query("graph_stats", f"""
WITH {_OPPOSED}, kn AS (WITH {_NEAR})
SELECT 'member' AS kind, count(*) AS n FROM v UNION ALL SELECT 'xsim', count(*) FROM kn UNION ALL SELECT 'conflict', count(*) FROM cf""")
def graph_stats(spark, sf):
    """Edges by kind of the graph with chunks."""
    return graph.graph_stats(_graph(spark, sf, 1_000_000)[1])


@query("graph_doc_level", f"""
WITH {_DOCV.replace('FROM embeddings', 'FROM embeddings JOIN benchmark ON item_id = vec_id')}, kn AS (WITH {_KNN('SELECT p.doc_id AS a, q.doc_id AS b, sum(p.x * q.x) AS w FROM dv p JOIN dv q ON p.i = q.i AND p.doc_id <> q.doc_id GROUP BY 1, 2', 'doc_id')})
SELECT 'doc:' || a AS s, 'doc:' || b AS t, 'xsim' AS kind, round(w, 3) + 0.0 AS w FROM kn""")
def graph_doc_level(spark, sf):
    """The graph of a corpus with too many chunks to show: its documents alone."""
    return _graph(spark, sf, 10)[1].withColumn("w", F.col("w") + 0.0)


# -- accounting and evaluation -----------------------------------------------------------------
_CITED = f"{_VERIFY}, cc AS (SELECT doc_id, count(*) AS cited FROM (SELECT DISTINCT query_id, sidx, rank, doc_id FROM pr) GROUP BY 1)"


def _counts(spark, sf) -> DataFrame:
    s, e = _sentences(spark, sf)
    return accounting.citation_counts(s.where(F.length("text") >= 8), e)


@query("citation_counts", f"WITH {_CITED} SELECT * FROM cc")
def citation_counts(spark, sf):
    return _counts(spark, sf)


@query("contribution_share", f"WITH {_CITED} SELECT doc_id, cited, round(cited / (SELECT sum(cited) FROM cc), 3) AS share FROM cc")
def contribution_share(spark, sf):
    return accounting.contribution_share(_counts(spark, sf))


def _titles(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.concat(F.lit("Title "), "item_id").alias("title"))


@query("source_catalog", f"WITH {_CITED} SELECT b.item_id AS doc_id, 'Title ' || b.item_id AS title, coalesce(cited, 0) AS cited, b.item_id % 7 <> 0 AS enabled FROM benchmark b LEFT JOIN cc ON cc.doc_id = b.item_id")
def source_catalog(spark, sf):
    d = _titles(spark, sf)
    return accounting.source_catalog(d, _counts(spark, sf), d.where("doc_id % 7 = 0").select("doc_id"))


@query("toggle_sources", "SELECT item_id AS doc_id FROM benchmark WHERE CASE WHEN item_id % 5 = 0 THEN item_id % 2 = 1 ELSE item_id % 7 = 0 END")
def toggle_sources(spark, sf):
    d = _titles(spark, sf)
    ghost = spark.range(1).select((F.col("id") - 1).alias("doc_id"))
    changes = d.where("doc_id % 5 = 0").select("doc_id").union(ghost).withColumn("enabled", F.col("doc_id") % 2 == 0)
    return accounting.toggle_sources(d.where("doc_id % 7 = 0").select("doc_id"), changes, d)


def _relevant(spark, sf) -> DataFrame:
    """Documents that hold a benchmark passage, by containment without white space."""
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return accounting.containing(q, bodies(spark, sf))


_RELEVANT = f"rel AS (SELECT b.item_id AS query_id, t.doc_id FROM (SELECT item_id, regexp_replace(text, '{_WS}+', '', 'g') AS p FROM benchmark) b JOIN (SELECT doc_id, regexp_replace(text, '{_WS}+', '', 'g') AS t FROM documents) t ON contains(t.t, b.p))"


@query("recall_mrr", f"""WITH RECURSIVE {_CHUNKS}, {_BM25}, {_RELEVANT},
rk AS (SELECT query_id, cidx // 1000000 AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25, 6) DESC, cidx) AS rank FROM sc),
bs AS (SELECT rel.query_id, min(rank) AS best FROM rel LEFT JOIN (SELECT * FROM rk WHERE rank <= 4) rk ON rk.query_id = rel.query_id AND rk.doc_id = rel.doc_id GROUP BY 1)
SELECT count(*) AS n, round(avg(CASE WHEN best IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS recall, round(avg(coalesce(1.0 / best, 0)), 6) AS mrr FROM bs""")
def recall_mrr(spark, sf):
    hits = _bm25(spark, sf).withColumn("doc_id", F.col("cidx.doc_id"))
    return accounting.recall_mrr(hits, _relevant(spark, sf)).select("n", F.round("recall", 6).alias("recall"), F.round("mrr", 6).alias("mrr"))


@query("refusal_rates", f"""WITH {_DENSE}, {_LEX}, {_hybrid()}, {_SIGNALS},
ng AS (SELECT doc_id FROM labels WHERE toxic = 1),
oc AS (SELECT query_id, CAST(split_part(query_id, '-', 1) AS BIGINT) IN (SELECT doc_id FROM ng) AS neg, n = 0 OR dense_top < 0.06 AS ref FROM sg)
SELECT round(count(*) FILTER (neg AND ref) / greatest(count(*) FILTER (neg), 1), 6) AS refusal_recall, round(count(*) FILTER (NOT neg AND ref) / greatest(count(*) FILTER (NOT neg), 1), 6) AS false_refusal FROM oc""")
def refusal_rates(spark, sf, corpus=_small):
    """Questions that should be refused: those of conversations labelled toxic; over the documents,
    those whose passage no document holds."""
    s = search.hybrid_search(*corpus(spark, sf))[1]
    if corpus is _small:
        negative = table(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("no")).distinct()
        s = s.join(negative, F.split_part("query_id", F.lit("-"), F.lit(1)).cast("long") == F.col("no"), "left").withColumn("is_negative", F.col("no").isNotNull())
    else:
        held = _relevant(spark, sf).select("query_id").distinct().withColumn("held", F.lit(True))
        s = s.join(held, "query_id", "left").withColumn("is_negative", F.col("held").isNull())
    out = accounting.refusal_rates(s.select("query_id", "is_negative", search.refused(bm25_available=False).alias("refused")))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("faithfulness", f"""WITH {_VERIFY}, z AS (SELECT greatest(count(*) FILTER (status <> 'advisory'), 1) AS n FROM rows)
SELECT round(coalesce(avg(similarity), 0), 6) AS mean_similarity, round(count(*) FILTER (similarity IS NOT NULL AND warn AND status <> 'contradiction') / any_value(z.n), 6) AS weak,
 round(count(*) FILTER (status = 'contradiction') / any_value(z.n), 6) AS contradiction, round(count(*) FILTER (status = 'uncited') / any_value(z.n), 6) AS uncited FROM rows, z""")
def faithfulness(spark, sf):
    out = accounting.faithfulness(_verified(spark, sf))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("answer_summary", f"WITH {_VERIFY} SELECT query_id, count(*) FILTER (status = 'contradiction') AS n_contradiction, count(*) FILTER (warn AND status = 'grounded') AS n_weak, count(*) FILTER (status = 'uncited') AS n_uncited FROM rows GROUP BY 1")
def answer_summary(spark, sf):
    return accounting.answer_summary(_verified(spark, sf))


_DENSITY = f"({_SUM('text', PROSE.strong)} + {_SUM('text', PROSE.weak)}) / greatest(length(text), 1)::DOUBLE * 1000"
_DISTINCT = " + ".join(f"CASE WHEN contains(text, '{m}') THEN 1 ELSE 0 END" for m in PROSE.strong)
_DOMAIN = f"k AS (SELECT doc_id, CAST(length(text) AS INTEGER) AS n_chars, {_DISTINCT} AS n_distinct, round({_DENSITY}, 2) AS score FROM documents WHERE length(text) >= 400 AND {_DISTINCT} >= 2 AND {_DENSITY} >= 1.2)"


@query("domain_filter", f"WITH {_DOMAIN} SELECT * FROM k")
def domain_filter(spark, sf):
    return accounting.domain_filter(bodies(spark, sf), PROSE)


@query("collector_rank", f"WITH {_DOMAIN} SELECT * FROM k ORDER BY score DESC, doc_id LIMIT 300")
def collector_rank(spark, sf):
    return accounting.collector_rank(accounting.domain_filter(bodies(spark, sf), PROSE))


# -- sources ----------------------------------------------------------------------------------
@query("front_matter", r"""
SELECT doc_id, 'T' || doc_id AS title, source AS publisher, text AS body FROM documents""")
def front_matter(spark, sf):
    raw = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("title: T"), "doc_id", F.lit("\npublisher:  "), "source", F.lit("\nno value\n---\n"), "text").alias("raw"))
    out = documents.front_matter(raw, "raw")
    return out.select("doc_id", F.col("meta")["title"].alias("title"), F.col("meta")["publisher"].alias("publisher"), "body")


@query("markup_strip", r"SELECT page_id, md5(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS digest FROM pages")
def markup_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(documents.strip_tags(F.col("html"))).alias("digest"))


@query("article_sections", rf"SELECT doc_id, source AS name, {_STRIP(f'''regexp_replace(text, '{_WS}+', ' ', 'g')''')} AS text FROM documents WHERE {_STRIP('text')} <> ''")
def article_sections(spark, sf):
    block = lambda name, text: F.concat(F.lit("<cntntsCl><CNTNTS_CL_NM><![CDATA["), name, F.lit("]]></CNTNTS_CL_NM><CNTNTS_CL_CN><![CDATA["), text, F.lit("]]></CNTNTS_CL_CN></cntntsCl>"))
    xml = F.concat(F.lit("<item><CNTNTS_SJ><![CDATA[ T ]]></CNTNTS_SJ>"), block(F.col("source"), F.col("text")), block(F.lit(T.SKIPPED_SECTIONS[0]), F.lit("x")), F.lit("</item>"))
    out = articles.article(table(spark, sf, "documents").select("doc_id", xml.alias("xml")), "xml")
    return out.select("doc_id", F.explode("sections").alias("s")).select("doc_id", "s.name", "s.text")


@query("feedback_log", "SELECT event_id, event_type AS rating, left(coalesce(props, ''), 500) AS comment FROM events WHERE event_id % 2 = 0")
def feedback_log(spark, sf):
    e = table(spark, sf, "events")
    body = F.to_json(F.struct(F.col("event_id"), F.col("event_type").alias("rating"), F.col("props").alias("comment")))
    lines = e.select(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("10:00 [FEEDBACK] "), body)).otherwise("other line").alias("value"))
    return feedback.from_log(lines, "event_id long, rating string, comment string").select("event_id", "rating", F.coalesce(T.cut_text(F.col("comment"), 500), F.lit("")).alias("comment"))


@query("embedding_search")
def embedding_search(spark, sf):
    """Hybrid search with vectors of an encoder: here hashed words, in place of a model."""
    b, u = _whole(spark, sf)
    hits, _ = search.hybrid_search(b, u, encode=lambda rows, kind: dense.encoded(rows, hashed_words, kind))
    return _hits(hits)


def hashed_words(texts: list[str]):
    """A stand-in for a bi-encoder: 64 buckets of words, of the text without its prefix."""
    import zlib

    import numpy as np

    out = np.zeros((len(texts), 64))
    for i, t in enumerate(texts):
        for w in t.split(": ", 1)[-1].lower().split():
            out[i, zlib.crc32(w.encode()) % 64] += 1
    return out


@query("evaluation_documents")
def evaluation_documents(spark, sf):
    """Benchmark passages as labelled questions: relevant are the documents that hold one whole, and
    a passage that none holds is a question to refuse."""
    held = _relevant(spark, sf).groupBy("query_id").agg(F.collect_set(F.col("doc_id").cast("string")).alias("relevant_docs"))
    b, u = _whole(spark, sf)
    q = u.join(held, "query_id", "left").select("query_id", F.col("text").alias("question"), F.coalesce("relevant_docs", F.array().cast("array<string>")).alias("relevant_docs"), F.col("relevant_docs").isNull().alias("is_negative"))
    return evaluate.evaluate(q, b, lexicon=PROSE)


@query("ask_documents")
def ask_documents(spark, sf):
    """Questions to verified answers over the documents."""
    b, u = _whole(spark, sf)
    out = ask.ask(b, _meta(spark, sf, _whole), u, lexicon=PROSE)
    n = out.verification.groupBy("query_id").agg(F.count("*").alias("n_checked"))
    return out.answers.join(n, "query_id", "left").select("query_id", "refused", "mode", "answer", F.coalesce("n_checked", F.lit(0)).alias("n_checked"))


# -- the same over the documents: no SQL, DuckDB is too slow for the grams of all chunks --------
def _over_documents(f):
    def run(spark, sf):
        return f(spark, sf, _whole)

    QUERIES[f"{f.__name__}_documents"] = run


for _f in (
    tfidf_charwb_topk, hybrid_search, rrf_fuse, search_excluding_sources, query_signals, refusal_decision, evidence_payload, numbered_evidence,
    source_conflict, refusal_rates, extractive_answer,
):
    _over_documents(_f)


from . import streams  # noqa: E402,F401  registers the streaming queries

