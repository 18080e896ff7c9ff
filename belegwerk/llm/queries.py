"""Registered queries of the operators and of the pipeline, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, read_table
from .fingerprints import fingerprints
from .near_dedup import near_duplicates
from .packing import packed
from .pii import KEY_SETTING, TABLE_KEY, pseudonymised
from .quality_classifier import quality_scores
from .quality_rules import RULES, STOP_WORDS, quality_rules
from .sentencepiece_codec import encoded
from .substring_dedup import without_repeats
from .token_counts import maintained
from .url_filters import url_verdicts

QUERIES = {}
ORACLE = {}


def _register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def _table(rules) -> str:
    """The threshold table as SQL conditions, for the oracle."""
    out = []
    for r in rules:
        broken = " OR ".join([f"{r.measure} < {r.least}"] * (r.least is not None) + [f"{r.measure} > {r.most}"] * (r.most is not None))
        out.append(f"CASE WHEN ({broken}) AND n_words >= {r.from_words} THEN '{r.name}' END")
    return f"list_filter([{', '.join(out)}], lambda x: x IS NOT NULL)"


_STOPS = ", ".join(f"'{x}'" for x in STOP_WORDS)
_OP1 = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^ \x09-\x0D]+') AS ws FROM t),
g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 3)) AS i,
         unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) AS s
  FROM w WHERE len(ws) >= 5),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM g) WHERE c > 1),
r AS (
  SELECT doc_id, sum(least(5, coalesce(nxt - i, 5))) AS c
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM d) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) AS ls FROM t),
m AS (
  SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(t, '[ \x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines,
    len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.c, 0) AS n_repeat_words,
    len(list_filter(ws, lambda x: lower(x) IN ({_STOPS}))) AS stops,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS small,
    length(regexp_replace(t, '[^!]', '', 'g')) AS marks
  FROM w JOIN l ON l.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id),
x AS (
  SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbols_per_word,
    n_dup_lines / greatest(n_lines, 1) AS dup_line_share, stops / greatest(n_words, 1) AS stop_word_share,
    upper / greatest(upper + small, 1) AS upper_share, marks / greatest(n_words, 1) AS mark_share,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM m),
y AS (SELECT *, {_table(RULES)} AS rules FROM x)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND len(rules) = 0 AS kept, array_to_string(rules, ',') AS broken
FROM y
"""


@_register("op1_quality_rules", _OP1)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))


_OP4 = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^ \\x09-\\x0D]+') AS ws
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS s
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT w.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.b) AS component_id, w.doc_id = min(r.b) AS kept
FROM w JOIN r ON r.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id GROUP BY w.doc_id
"""


@_register("op4_minhash_near_dedup", _OP4)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), k=4, percent=80)


@_register("op6_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read_table(spark, sf_dir, "documents"))


_OP9 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \x09-\x0D]+') AS ws FROM documents),
g AS (
  SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i,
         unnest(list_transform(range(1, len(ws) - 48), lambda i: md5(array_to_string(ws[i:i+49], ' ')))) AS s
  FROM w WHERE len(ws) >= 50),
b AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS o FROM g) WHERE o < doc_id),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM b),
p AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
k AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS kept, count(*) AS n FROM p ANTI JOIN r ON p.doc_id = r.doc_id AND p.i = r.i GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""


@_register("op9_substring_dedup", _OP9)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(read_table(spark, sf_dir, "documents"), keep_text=False)


@_register("op5_pii")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonymised(docs, spark.conf.get(KEY_SETTING, None) or TABLE_KEY)
    return out.select("doc_id", F.size("_kinds").cast("long").alias("n_found"), F.array_join("_kinds", ",").alias("kinds"), "text")


@_register("op8_fingerprints")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))


@_register("op2_url_filters")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(read_table(spark, sf_dir, "pages"))


@_register("op3_quality_classifier")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@_register("op7_token_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintained(read_table(spark, sf_dir, "documents"), fresh_path(spark, "token-rollup"))


@_register("op10_sentencepiece")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read_table(spark, sf_dir, "documents"), keep_ids=False)


@_register("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
