from pyspark.sql import functions as F

from belegwerk.config import KOREAN
from belegwerk.functions import text as T


def value(spark, column, **row):
    names, values = list(row), [tuple(row.values())]
    return spark.createDataFrame(values, names).select(column.alias("v")).first()["v"]


def test_clean_drops_pages_links_and_controls(spark):
    raw = "A\x01b\n- 12 -\nhttps://a.b/c\n본문  줄   \n\n\n\n끝.　"
    assert value(spark, T.clean_extracted(F.col("t")), t=raw) == "A b\n본문 줄\n\n끝."


def test_sentences_follow_korean_enders_and_odd_spaces(spark):
    assert value(spark, T.split_sentences(F.col("t")), t="　먹여도 된다. 안 된다 그래요 끝") == ["먹여도 된다.", "안 된다", "그래요", "끝"]
    assert value(spark, T.split_claims(F.col("t")), t="짧다.\n충분히 긴 문장이다.\nabcd\nabcde") == ["충분히 긴 문장이다.", "abcde"]


def test_clean_sentences_skip_short_headings(spark):
    got = value(spark, T.clean_sentences(F.col("t")), t="Heading\n\nThis is a full sentence that is long enough. Next one here.\n요약이다")
    assert got == ["This is a full sentence that is long enough.", "Next one here.", "요약이다"]


def test_wellformed(spark):
    for s, want in (("Too short.", False), ("A full sentence here.", True), ("은 시작이 나쁜 문장이다.", False), ("no end of this one", False)):
        assert value(spark, T.is_wellformed(F.col("t")), t=s) is want


def test_tokens(spark):
    assert value(spark, T.tokens(F.col("t")), t="A Bb_1 열이 é Éa") == ["bb_1", "열이", "éa"]
    assert value(spark, T.content_tokens(F.col("t")), t="aa aa b") == ["aa"]


def test_polarity_counts_overlapping_markers(spark):
    for s, want in (("먹여도 된다", 1), ("먹이면 안 된다", -1), ("권장되지 않는다", -1), ("보통", 0)):
        assert value(spark, T.polarity(F.col("t"), KOREAN), t=s) == want


def test_license_classes(spark):
    for s, want in (("", "unknown"), ("Unknown", "unknown"), ("All Rights Reserved", "arr"), ("공공누리 제4유형 변경금지", "nd"), ("CC BY-ND", "nd"), ("cc by", "open"), ("accident", "open"), ("MIT", "unknown")):
        assert value(spark, T.license_class(F.col("t")), t=s) == want
    assert value(spark, T.license_class(F.col("t"), strict=True), t="accident") == "unknown"


def test_citations_out_of_range_go(spark):
    got = value(spark, T.parse_citations(F.col("t"), 2), t="One [2][1][2]. Two [9]. [1]")
    assert [(s["text"], s["citations"]) for s in got] == [("One .", [1, 2]), ("Two .", [])]


def test_llm_json(spark):
    good = '```json\n{"sentences": [{"text": " a ", "citations": [2, "1", 7]}, {"text": ""}]}\n```'
    got = value(spark, T.parse_llm_json(F.col("t"), 3), t=good)
    assert [(s["text"], s["citations"]) for s in got] == [("a", [1, 2])]
    assert value(spark, T.parse_llm_json(F.col("t"), 3), t='{"sentences": []}') == []
    assert value(spark, T.parse_llm_json(F.col("t"), 3), t="no json") is None
    assert value(spark, T.parse_llm_json(F.col("t"), 3), t="{broken") is None


def test_safe_name_and_frames(spark):
    assert value(spark, T.safe_name(F.col("t")), t=' a/b: "c"  d ') == "ab_c_d"
    frame = value(spark, T.sse_frame(F.lit("delta"), F.struct(F.col("t").alias("x"))), t="y")
    assert frame == 'event: delta\ndata: {"x":"y"}\n\n'
    got = value(spark, T.parse_sse(F.col("t")), t=frame)
    assert (got["event"], got["data"]) == ("delta", '{"x":"y"}')
