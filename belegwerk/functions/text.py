"""Text rules as Column expressions.

White space follows Unicode: Java's ``\\s`` with the (?U) flag, plus the separators that only
string stripping knows. Lengths and offsets count code points.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Lexicon, Settings

# fixed values
ENDERS = ".다요"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
PAGE_NUMBER = r"(?U)^[-–—\s]*\d{1,3}[-–—\s]*$"
JUNK_LINK = r"(?U)^\s*(?:https?://\S+|\S*(?:fileDown|FileDown|healthInfoFileDown)\S*|\S*\?SEQ=\S*)\s*$"
TAIL_OK = r"(?:다|요|음|임)[.!?]?$|[.!?]$"
HEAD_BAD = r"(?U)^(?:[,)\]·•]|고,|며,|서,|은|는|을|를|이|가)\s"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
OPEN_MARKS, ND_MARK = ("공공누리", "출처표시"), "변경금지"
QUOTE_ONLY = "〔원문 그대로만 인용〕"
LICENSE_LABELS = {
    "open": "자유이용(출처표시)",
    "nd": "변경금지 · 원문 인용만",
    "arr": "All rights reserved · 원문 인용만",
    "unknown": "이용조건 미확인 · 원문 인용만",
}
SKIPPED_SECTIONS = ("참고문헌", "연관 주제어", "연관주제어")
SENTINEL = "__NO_ANSWER__"
NO_EVIDENCE = "제공된 자료에서 근거를 찾지 못했습니다."
NOT_FOUND = "지식 팩에서 이 질문의 근거를 찾지 못했습니다. 다른 질문을 해보시거나 전문가와 상담하세요."
NOT_ANSWERED = "검증된 자료에서 이 질문의 근거를 찾지 못했습니다. 질문을 바꿔 보시거나 전문가와 상담하세요."
#: Conjunctions that begin whole sentences, though they look like the end of a clause.
HEAD_WORDS = ("그리고", "그러나", "하지만", "또한", "따라서", "그래서", "만약", "다만", "특히", "예를", "만일", "그러므로")
CLAUSE_TAG, MODIFIER_TAG = "EC", "ETM"
CONTENT_TAGS, NUMBER_TAG = ("N", "V", "S", "X", "M"), "SN"

#: A morphological analyzer: text -> array<struct<form: string, tag: string>>, null where it has
#: nothing to say. None is shipped; a pandas UDF around one fits.
Analyzer = Callable[[Column], Column]

_EDGE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def strip(x: Column) -> Column:
    return F.regexp_replace(x, _EDGE, "")


def rstrip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)[\s\x1c-\x1f]+$", "")


def squash(x: Column) -> Column:
    """All white space out: the key by which quotes are compared."""
    return F.regexp_replace(x, r"(?U)[\s\x1c-\x1f]+", "")


def clean_extracted(text: Column) -> Column:
    """Control characters to spaces, page-number and bare-link lines out, runs of blanks squeezed."""
    lines = F.split(F.regexp_replace(text, CONTROL, " "), LINE_END)
    kept = F.filter(lines, lambda x: ~strip(x).rlike(PAGE_NUMBER) & ~strip(x).rlike(JUNK_LINK))
    joined = F.array_join(F.transform(kept, rstrip), "\n")
    return strip(F.regexp_replace(F.regexp_replace(joined, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))


def _pieces(text: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(strip(text), pattern), strip), lambda x: x != "")


def split_sentences(text: Column) -> Column:
    return _pieces(text, rf"(?U)(?<=[{ENDERS}])\s+")


def split_claims(text: Column) -> Column:
    """Sentences and lines of more than four code points."""
    return F.filter(_pieces(text, rf"(?U)(?<=[{ENDERS}])\s+|\n+"), lambda x: F.length(x) > 4)


def starts_midclause(s: Column, analyzer: Analyzer | None = None) -> Column:
    """Whether the first word is the tail of a clause cut off before it: it ends in a connective, or
    is short and ends in a modifier. Never without an analyzer, nor where it fails."""
    if analyzer is None:
        return F.lit(False)
    head = F.regexp_extract(s, r"(?U)^[\s\x1c-\x1f]*([^\s\x1c-\x1f]+)", 1)
    found = analyzer(head)
    last = F.try_element_at(found, F.lit(-1))["tag"]
    cut = (last == CLAUSE_TAG) | ((last == MODIFIER_TAG) & (F.length(head) <= 3))
    return (head != "") & ~head.isin(*HEAD_WORDS) & F.coalesce(cut, F.lit(False))


def is_wellformed(s: Column, analyzer: Analyzer | None = None) -> Column:
    """Complete as a sentence; the test of the first word's morphology needs an analyzer."""
    return (F.length(s) >= 12) & s.rlike(TAIL_OK) & ~s.rlike(HEAD_BAD) & ~starts_midclause(s, analyzer)


def clean_sentences(text: Column, wellformed_only: bool = False) -> Column:
    """Sentences of the paragraphs, without short headings. A Python analyzer can't run inside this
    expression: explode the sentences and filter them by ``is_wellformed`` instead."""
    paragraphs = F.filter(F.transform(F.split(text, r"(?U)\n\s*\n|\n"), strip), lambda p: (p != "") & ((F.length(p) >= 20) | p.rlike(f"[{ENDERS}]$")))
    out = F.flatten(F.transform(paragraphs, split_sentences))
    return F.filter(out, lambda s: is_wellformed(s)) if wellformed_only else out


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), 0)


def tokens(text: Column, analyzer: Analyzer | None = None) -> Column:
    """Lower-cased words of two code points or more. With an analyzer: content morphemes of two code
    points or more and numbers of any length; without any, all words as they are."""
    if analyzer is None:
        return F.filter(_words(F.lower(text)), lambda t: F.length(t) > 1)
    wanted = lambda m: (F.left(m["tag"], F.lit(1)).isin(*CONTENT_TAGS) & (F.length(m["form"]) > 1)) | m["tag"].startswith(NUMBER_TAG)
    forms = F.transform(F.filter(F.coalesce(analyzer(text), F.array().cast("array<struct<form:string,tag:string>>")), wanted), lambda m: m["form"])
    return F.when(F.size(forms) > 0, forms).otherwise(_words(text))


def content_tokens(text: Column, analyzer: Analyzer | None = None) -> Column:
    """The set of tokens of two code points or more; words of Latin letters, digits and Hangul where
    there are none."""
    known = F.array_distinct(F.filter(tokens(text, analyzer), lambda t: F.length(t) > 1))
    return F.when(F.size(known) > 0, known).otherwise(F.array_distinct(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9가-힣]{2,}"), 0)))


def _count(text: Column, marker: str) -> Column:
    """Occurrences that do not overlap."""
    return F.call_function("div", F.length(text) - F.length(F.replace(text, F.lit(marker), F.lit(""))), F.lit(len(marker)))


def marker_count(text: Column, markers: tuple[str, ...]) -> Column:
    """Occurrences of each marker, added up; markers inside others count too."""
    return sum((_count(text, m) for m in markers), F.lit(0))


def polarity(text: Column, lexicon: Lexicon) -> Column:
    return F.signum(marker_count(text, lexicon.positive) - marker_count(text, lexicon.negative)).cast("int")


def is_advisory(text: Column, lexicon: Lexicon) -> Column:
    out = F.lit(False)
    for hint in lexicon.advisory:
        out = out | text.contains(hint)
    return out


def license_class(s: Column, strict: bool = False) -> Column:
    """open, nd, arr or unknown. ``strict`` asks for "cc" as a word of its own."""
    s = F.trim(F.coalesce(s, F.lit("")))
    low = F.lower(s)
    cc = low.rlike(r"\bcc\b") if strict else low.contains("cc")
    return (
        F.when((s == "") | (low == "unknown"), "unknown")
        .when(low.contains("all rights"), "arr")
        .when(s.contains(ND_MARK) | low.contains("-nd"), "nd")
        .when(s.contains(OPEN_MARKS[0]) | s.contains(OPEN_MARKS[1]) | cc, "open")
        .otherwise("unknown")
    )


def allow_rewrite(cls: Column) -> Column:
    return cls == "open"


def license_label(cls: Column) -> Column:
    pairs = [F.lit(x) for pair in LICENSE_LABELS.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), cls)


def domain_stats(text: Column, lexicon: Lexicon) -> tuple[Column, Column]:
    """(distinct strong markers, markers per 1000 code points)."""
    distinct = sum((F.when(text.contains(m), 1).otherwise(0) for m in lexicon.strong), F.lit(0))
    total = marker_count(text, lexicon.strong) + marker_count(text, lexicon.weak)
    return distinct, total / F.greatest(F.length(text), F.lit(1)) * 1000


def in_domain(text: Column, lexicon: Lexicon, settings: Settings = DEFAULT) -> Column:
    distinct, density = domain_stats(text, lexicon)
    return (distinct >= settings.min_distinct) & (density >= settings.min_density)


def safe_name(name: Column) -> Column:
    plain = F.regexp_replace(name, r'[\\/:*?"<>|]+', "")
    return F.left(F.regexp_replace(strip(plain), r"(?U)\s+", "_"), F.lit(40))


def render(sentences: Column) -> Column:
    """``array<struct<text, citations>>`` as text with ``[n]`` marks."""
    return F.array_join(
        F.transform(sentences, lambda s: F.concat(s["text"], F.array_join(F.transform(s["citations"], lambda c: F.concat(F.lit("["), c.cast("string"), F.lit("]"))), ""))),
        " ",
    )


def parse_citations(text: Column, n_evidence: Column | int) -> Column:
    """Plain text with ``[n]`` marks -> ``array<struct<text, citations>>``; marks out of range go."""
    n = n_evidence if isinstance(n_evidence, Column) else F.lit(n_evidence)

    def one(raw: Column) -> Column:
        marks = F.transform(F.regexp_extract_all(raw, F.lit(r"\[(\d+)\]"), 1), lambda m: m.try_cast("int"))
        kept = F.array_sort(F.array_distinct(F.filter(marks, lambda m: m.between(1, n))))
        return F.struct(strip(F.regexp_replace(raw, r"\[\d+\]", "")).alias("text"), kept.alias("citations"))

    return F.filter(F.transform(split_sentences(text), one), lambda s: s["text"] != "")


_ANSWER = "struct<sentences:array<struct<text:string,citations:array<string>>>>"


def parse_llm_json(text: Column, n_evidence: Column | int) -> Column:
    """The sentences of a JSON answer, fenced or with prose around it; null where none parses.
    An answer without sentences is an empty array: a refusal."""
    n = n_evidence if isinstance(n_evidence, Column) else F.lit(n_evidence)
    # a text in a fence loses the fence's first line, which a brace may stand in
    fenced = F.regexp_replace(F.regexp_replace(strip(text), "^`+[^\\n]*\\n", ""), "`+$", "")
    body = F.regexp_extract(F.when(strip(text).startswith("```"), fenced).otherwise(text), r"(?s)\{.*\}", 0)
    raw = F.from_json(body, _ANSWER)
    valid = (body != "") & F.try_parse_json(body).isNotNull()

    def one(s: Column) -> Column:
        marks = F.filter(s["citations"], lambda c: c.rlike(r"^\d+$"))
        kept = F.filter(F.transform(marks, lambda c: c.try_cast("int")), lambda c: c.between(1, n))
        none = F.array().cast("array<int>")
        return F.struct(strip(s["text"]).alias("text"), F.coalesce(F.array_sort(F.array_distinct(kept)), none).alias("citations"))

    kept = F.transform(F.filter(raw["sentences"], lambda s: s["text"].isNotNull() & (s["text"] != "")), one)
    empty = F.array().cast("array<struct<text:string,citations:array<int>>>")
    return F.when(valid, F.coalesce(kept, empty))


def sse_frame(event: Column, data: Column) -> Column:
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), F.to_json(data), F.lit("\n\n"))


def parse_sse(frame: Column) -> Column:
    """struct(event, data) of one frame."""
    lines = F.split(frame, "\n")
    value = lambda name: F.try_element_at(
        F.transform(F.filter(lines, lambda x: x.startswith(f"{name}: ")), lambda x: F.substring(x, len(name) + 3, 1 << 30)), F.lit(1)
    )
    return F.struct(value("event").alias("event"), value("data").alias("data"))


def cut_text(text: Column, most: int) -> Column:
    return F.left(text, F.lit(most))
