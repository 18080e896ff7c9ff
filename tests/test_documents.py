"""Retrieval over the chunks of the documents, against brute force."""

import math
import re
from collections import Counter

import pytest

from belegwerk.operators import chunking
from belegwerk.plans.catalog import QUERIES

DOCS = [
    (3, "The infant has a fever and must rest today. " * 6 + "Licence: CC BY 4.0\n" + "A fever is always treated with rest at home. " * 8, "a"),
    (4, "".join(f"Honey number{i * i} should never be given to an infant before year{i}. " for i in range(12)), "b"),
    (5, "Sleep and rest help every child with a fever. " * 3, "a"),
    (6, "".join(f"Completely unrelated word{i * 7} about ships{i} and harbours of port{i * i}. " for i in range(30)), "c"),
    (7, "", "c"),
]
ASKED = [(0, "infant fever rest"), (1, "ships3 in harbours of port81"), (2, "qqq")]


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(DOCS, "doc_id long, text string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(ASKED, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def place(r):
    """The number by which this file names a chunk."""
    doc, i = r["chunk_id"].split("--")
    return int(doc) * 1_000_000 + int(i)


def chunked():
    out = {}
    for d, t, _ in DOCS:
        texts = [t[a:b].strip() for a, b in chunking.spans(t, 400, 80)]
        out |= {d * 1_000_000 + i: x for i, x in enumerate(x for x in texts if x)}
    return out


def char_grams(text):
    out = Counter()
    for w in text.lower().split():
        w = f" {w} "
        for n in (2, 3, 4):
            if n == 4 and len(w) <= 3:
                continue
            out.update(w[i : i + n] for i in range(max(len(w) - n + 1, 1)))
    return out


def cosines():
    grams = {c: char_grams(t) for c, t in chunked().items()}
    df = Counter(g for v in grams.values() for g in v)
    idf = {g: math.log((1 + len(grams)) / (1 + n)) + 1 for g, n in df.items()}

    def unit(v):
        v = {g: n * idf[g] for g, n in v.items() if g in idf}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {g: x / norm for g, x in v.items()}

    units = {c: unit(v) for c, v in grams.items()}
    return {(q, c): sum(x * v.get(g, 0.0) for g, x in unit(char_grams(t)).items()) for q, t in ASKED for c, v in units.items()}


def lexical():
    words = {c: [w for w in re.findall(r"\w+", t.lower()) if len(w) > 1] for c, t in chunked().items()}
    n, avg = len(words), sum(map(len, words.values())) / len(words)
    df = Counter(w for v in words.values() for w in set(v))
    idf = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    return {(q, c): sum(idf.get(w, 0) * v.count(w) * 2.5 / (v.count(w) + 1.5 * (0.25 + 0.75 * len(v) / avg)) for w in re.findall(r"\w+", t.lower())) for q, t in ASKED for c, v in words.items()}


def fused(off=()):
    dense, lex = cosines(), lexical()
    out = {}
    for q, _ in ASKED:
        on = [c for c in chunked() if c // 1_000_000 not in off]
        ranks = [{c: i + 1 for i, c in enumerate(sorted(on, key=lambda c: (-round(s[q, c], 9), c))[:4])} for s in (dense, lex)]
        score = {c: sum(1 / (60 + r[c]) for r in ranks if c in r) for c in {*ranks[0], *ranks[1]}}
        out[q] = sorted(score, key=lambda c: (-round(score[c], 12), ranks[0].get(c, 99), ranks[1].get(c, 99)))[:4]
    return out


def test_search_ranks_chunks_of_documents(spark, sf):
    dense, lex = cosines(), lexical()
    for name, off in (("hybrid_search_documents", ()), ("search_excluding_sources_documents", (3, 6))):
        got = {}
        for r in QUERIES[name](spark, sf).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(place(r))
            assert r["doc_id"] == place(r) // 1_000_000
            assert r["score"] == pytest.approx(dense[r["query_id"], place(r)], abs=1e-6) and r["bm25_score"] == pytest.approx(lex[r["query_id"], place(r)], abs=1e-6)
        assert got == fused(off)


def test_signals_and_answers_come_from_documents(spark, sf):
    dense, lex = cosines(), lexical()
    for r in QUERIES["query_signals_documents"](spark, sf).collect():
        for c, s in (("dense_top", dense), ("bm25_top", lex)):
            assert r[c] == pytest.approx(max(0.0, *(v for (q, _), v in s.items() if q == r["query_id"])), abs=1e-6)
    assert {r["query_id"]: r["refused"] for r in QUERIES["refusal_decision_documents"](spark, sf).collect()} == {0: False, 1: False, 2: True}
    payload = QUERIES["evidence_payload_documents"](spark, sf).collect()
    assert {r["title"] for r in payload} <= {f"Document {d}" for d, _, _ in DOCS} and any(r["lic_class"] == "open" for r in payload)
    answers = {r["query_id"]: r["answer"] for r in QUERIES["extractive_answer_documents"](spark, sf).collect()}
    assert "harbours" in answers[1]
    best = {r["query_id"]: place(r) for r in QUERIES["tfidf_charwb_topk_documents"](spark, sf).where("rank = 1").collect()}
    assert best == {q: max(chunked(), key=lambda c: dense[q, c]) for q in (0, 1)}
