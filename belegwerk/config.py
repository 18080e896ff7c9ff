"""Settings of retrieval and verification, and the word lists they use."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # fixed values
    chunk_size: int = 400
    chunk_overlap: int = 80
    top_k: int = 4
    pool: int = 4
    rrf_k: int = 60
    sim_warn: float = 0.45
    sim_reject: dict = field(default_factory=lambda: {"sbert": 0.30, "tfidf": 0.06})
    bm25_reject: float = 0.0
    rerank_reject: float = 0.08
    min_distinct: int = 2
    min_density: float = 1.2
    min_length: int = 400
    max_keep: int = 300
    knn: int = 3
    graph_limit: int = 120
    conflict_similarity: float = 0.88


@dataclass(frozen=True)
class Lexicon:
    """Marker lists of a language."""

    negative: tuple[str, ...]
    positive: tuple[str, ...]
    advisory: tuple[str, ...]
    advice: str
    strong: tuple[str, ...]
    weak: tuple[str, ...]


# fixed values
KOREAN = Lexicon(
    negative=(
        "안 된다", "안된다", "안 돼", "하면 안", "되지 않", "하지 않", "않는다",
        "말고", "말아야", "마세요", "금지", "금한다", "비권장", "권장되지", "권장하지",
        "불가", "삼가", "피한다", "피해야", "피하", "주의", "위험", "임의로 투여하지",
        "투여하지", "먹이지", "주지", "없다", "없이", "못한다", "불충분",
    ),
    positive=(
        "해도 된다", "해도 됩니다", "할 수 있다", "투여할 수 있다", "사용할 수 있다",
        "가능하다", "권장한다", "권장된다", "권장되며", "권장", "괜찮다", "안전하다",
        "시작한다", "먹여도", "먹일 수", "주어도", "복용할 수",
    ),
    advisory=("상담", "전문의", "의료기관", "병원"),
    advice="정확한 판단이 필요하면 소아청소년과 전문의와 상담하세요.",
    strong=("영유아", "소아", "신생아", "영아", "유아기", "어린이", "이유식", "모유", "예방접종", "수유"),
    weak=("아기", "생후", "개월", "돌 전"),
)

#: Markers for the invented European prose of the test tables.
PROSE = Lexicon(
    negative=("not ", "nicht", " pas ", " no ", "idiot", "loser"),
    positive=(" is ", " ist ", " est ", " es "),
    advisory=("with", "mit ", "avec", "con "),
    advice="Please ask an expert with experience.",
    strong=("that", "tion", "keit", "eau", "ado"),
    weak=("the ", "der ", "les ", "los "),
)

DEFAULT = Settings()
