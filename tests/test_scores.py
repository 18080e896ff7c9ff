"""Scores made in one walk, from either side, against brute force."""

import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from belegwerk.operators import dense, lexical, scores
from belegwerk.plans import store

TEXTS = ["Honey for an infant, honey!", "the fever of an infant", "", "ships in ports", "honey for an infant honey", None, "x\x1cy a", "fever Fever"]


def test_terms_are_letters_digits_and_underscores():
    for c in map(chr, range(sys.maxunicode + 1)):
        assert bool(scores._TERM.fullmatch(c)) == (unicodedata.category(c)[0] in "LN" or c == "_")


def test_grams_are_those_of_the_column(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS if t is not None], "text string").select(F.lower("text").alias("t"), dense.char_grams(F.col("text")).alias("g"))
    for r in rows.collect():
        assert sorted(g for w in scores.words(r["t"]) for g in scores.grams(w)) == sorted(r["g"])


@pytest.mark.parametrize("known", [None, ["ab", " ab", "bcd ", "\U0001f600 ", "abcd", "zz"]])
def test_words_are_cut_together(monkeypatch, known):
    """A loop over the grams of each new word took most of a search's time."""
    texts = ["ab abcd a", "", None, "x\U0001f600 abcd ab", "bcd 가나 zzz"]
    want = [sorted(g for w in scores.words(t or "") for g in scores.grams(w) if known is None or g in known) for t in texts]
    monkeypatch.setattr(scores, "grams", None)
    words = scores._Words(known, None, True, True)
    got = [[] for _ in texts]
    for lo in (0, 3):  # a later batch adds words
        row, number = words.of_grams(*words.read(texts[lo : lo + 3]))
        names = words.gram.names() if known is None else known
        for r, i in zip(row, number):
            got[lo + r].append(names[i])
    assert [sorted(x) for x in got] == want


def test_candidates_are_ranked_by_exact_sums(spark):
    """Products of 4-byte numbers alone would take any of these: they differ beyond the 8th place."""
    base = " ".join(f"w{i}x{j}" for i in range(40) for j in range(10))
    chunks = spark.createDataFrame([(i, base + " q" * (i % 7) + " end") for i in range(40)], "cidx long, text string")
    queries = spark.createDataFrame([(0, base * 3 + " q"), (1, "q end"), (2, "nothing")], "query_id long, text string")
    known = scores.vocabulary(chunks)
    every = {(r["query_id"], r["cidx"]): r["dense"] for r in scores.best(chunks, queries, known, 40, ("dense",)).collect()}
    assert len(every) == 120
    for q in range(3):
        want = sorted(range(40), key=lambda i: (-round(every[q, i], 12), i))[:3]
        got = {r["cidx"] for r in scores.best(chunks, queries.where(f"query_id = {q}"), known, 3, ("dense",)).collect()}
        assert set(want) <= got


def test_a_table_of_one_file_is_many_tasks(spark, tmp_path):
    spark.range(100).coalesce(1).write.parquet(str(tmp_path / "t"))
    one = spark.read.parquet(str(tmp_path / "t"))
    parts = store.spread(one)
    assert parts.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism and store.spread(parts) is parts
    assert {r[0] for r in parts.collect()} == set(range(100))


@pytest.mark.parametrize("many", ["questions", "chunks"])
def test_the_best_from_either_side_and_in_blocks(spark, monkeypatch, many):
    """A plan or a table on the driver for each 256 questions failed where questions are many."""
    monkeypatch.setattr(scores, "BLOCK", 2)
    texts = {i: t for i, t in enumerate(TEXTS)}
    few = {i: t for i, t in enumerate(["infant honey", "an", "", "qqq ports", "fever"])}
    c, q = (few, texts) if many == "questions" else (texts, few)
    chunks, queries = spark.createDataFrame(list(c.items()), "cidx long, text string"), spark.createDataFrame(list(q.items()), "query_id long, text string")
    known = scores.vocabulary(chunks)
    index = lexical.build_index(chunks)
    exact = {(r["query_id"], r["cidx"]): r["bm25"] for r in lexical.bm25_scores(index, queries).collect()}
    for matched in (False, True):
        best = scores.best(chunks, queries, known, 2, ("bm25",), matched=matched)
        got = {(r["query_id"], r["rank"]): (r["cidx"], r["bm25"]) for r in lexical.top_ranked(best.withColumn("p", F.round("bm25", 9)), "p", 2, "rank").collect()}
        for i in q:
            mine = [(-round(exact.get((i, j), 0.0), 9), j) for j in c if not matched or (i, j) in exact]
            want = sorted(mine)[:2]
            assert [got[i, r + 1][0] for r in range(len(want))] == [j for _, j in want]
            assert [got[i, r + 1][1] for r in range(len(want))] == pytest.approx([-x for x, _ in want], abs=1e-9)
            assert (i, len(want) + 1) not in got
    idf = {r["gram"]: r["idf"] for r in known.features.collect()}

    def unit(t):
        v = {}
        for g in (g for w in (t or "").lower().replace("\x1c", "\x1d").split(" ") if w for g in scores.grams(w)):
            v[g] = v.get(g, 0) + idf.get(g, 0)
        norm = sum(x * x for x in v.values()) ** 0.5 or 1.0
        return {g: x / norm for g, x in v.items()}

    for r in scores.best(chunks, queries, known, 9, ("dense",)).collect():
        a, b = unit(q[r["query_id"]].replace("\x1c", "\x1d") if q[r["query_id"]] else ""), unit(c[r["cidx"]])
        if "\x1c" not in (q[r["query_id"]] or "") + (c[r["cidx"]] or ""):
            assert r["dense"] == pytest.approx(sum(x * b.get(g, 0.0) for g, x in a.items()), abs=1e-9)


def test_nearest_rows_in_strips_and_tiles(spark, monkeypatch):
    """Pairs of small blocks were joined: a block went to the driver, or by shuffle, once for each other."""
    import numpy as np

    monkeypatch.setattr(dense, "TILE", (3, 5))
    rng = np.random.default_rng(2)
    v = rng.normal(size=(12, 4))[rng.integers(0, 12, 60)]  # copies tie
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, i % 7, x.tolist()) for i, x in enumerate(v)], "id long, own long, v array<double>")
    for apart in (False, True):
        found = dense.block_top_k(rows, rows, 3, block=20, apart=apart)
        assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
        got = {(r["query_id"], r["rank"]): r["cidx"] for r in found.collect()}
        sims = (v @ v.T).round(10)
        for i in range(60):
            want = sorted((j for j in range(60) if j != i and not (apart and j % 7 == i % 7)), key=lambda j: (-sims[i, j], j))[:3]
            assert [got[i, r + 1] for r in range(3)] == want


@pytest.mark.parametrize("known", [None, ["ab", " 가", "나 ", "xyz ", "yz", "가나다"]])
def test_grams_of_texts_in_array_passes(monkeypatch, known):
    """A pass over each distinct word took most of a search's time; characters beyond the arrays are found too."""
    texts = ["ab　xyz  ab\n", None, "  ", "가나다 \U0001f600\x1cb é\x00", "a", "xyz\tab 가나다"] + [chr(0x4E00 + i) * 3 for i in range(9)]
    want = [sorted(g for w in scores.words(t or "") for g in scores.grams(w) if known is None or g in known) for t in texts]
    for wide, high in ((1024, 4096), (3, 4)):
        monkeypatch.setattr(scores, "WIDE", wide)
        monkeypatch.setattr(scores, "HIGH", high)
        cut = scores._Grams(known)
        got = [[] for _ in texts]
        for lo in (0, 4, 8, 20):
            row, number = cut.of(*cut.read(texts[lo : lo + 4] if lo < 8 else texts[lo:20]))
            names = cut.names() if known is None else known
            for r, i in zip(row.tolist(), number.tolist()):
                got[lo + r].append(names[i])
        assert [sorted(x) for x in got] == want


def test_counts_that_are_sent_on_early(spark, monkeypatch):
    """A corpus of more grams and terms than a task keeps, in slices, has the same vocabulary."""
    chunks = spark.createDataFrame([(i, f"Honey w{i} w{i % 7} ex{i}ample, honey") for i in range(60)], "cidx long, text string").coalesce(1)

    def made():
        v = scores.vocabulary(chunks)
        return sorted(map(tuple, v.terms.collect())), sorted(map(tuple, v.features.collect())), v.stats.first()

    whole = made()
    for name, value in (("CACHED", 9), ("COUNTED", 50), ("SLICE", 4)):
        monkeypatch.setattr(scores, name, value)
    terms, features, stats = made()
    assert [t[:2] for t in terms] == [t[:2] for t in whole[0]] and [t[2] for t in terms] == pytest.approx([t[2] for t in whole[0]])
    assert features == whole[1] and stats == whole[2]


@pytest.mark.parametrize("few", [0, 1, 99])
def test_rare_grams_are_summed_one_by_one(spark, monkeypatch, few):
    """Products of rare grams were a matrix of all of them for each chunk, most of it zeros."""
    monkeypatch.setattr(scores, "FEW", few)
    chunks = spark.createDataFrame([(i, f"honey for infant{i % 5} w{i}") for i in range(30)], "cidx long, text string")
    queries = spark.createDataFrame([(0, "infant1 w7"), (1, "honey"), (2, ""), (3, "w7 infant3 w29")], "query_id long, text string")
    known = scores.vocabulary(chunks)
    got = {(r["query_id"], r["cidx"]): r["dense"] for r in scores.best(chunks, queries, known, 30, ("dense",)).collect()}
    monkeypatch.setattr(scores, "FEW", 2)
    want = {(r["query_id"], r["cidx"]): r["dense"] for r in scores.best(chunks, queries, known, 30, ("dense",)).collect()}
    assert len(got) == 120 and got == pytest.approx(want, abs=1e-12)
    assert max(range(30), key=lambda c: got[0, c]) == 7


def test_no_table_of_all_questions_goes_to_the_driver(spark):
    """Ranks, scores and signals were joined, the smaller table by way of the driver."""
    from belegwerk.operators import search

    chunks = spark.createDataFrame([(i, i // 2, f"honey w{i} for infants") for i in range(6)], "cidx long, doc_id long, text string")
    queries = spark.createDataFrame([(i, f"honey w{i % 9}") for i in range(40)] + [(40, None)], "query_id long, text string")
    hits, signals = search.hybrid_search(chunks, queries)
    plan = signals._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan
    got = {r["query_id"]: r for r in signals.collect()}
    assert len(got) == 41 and got[40]["n_hits"] == 4 and got[40]["dense_top"] == got[40]["bm25_top"] == 0.0
    top = {r["query_id"]: r for r in hits.where("rank = 1").collect()}
    assert top[3]["cidx"] == 3 and top[3]["score"] == got[3]["dense_top"] and top[3]["bm25_score"] == got[3]["bm25_top"]


def test_two_texts_meet_once_for_conflicts(spark):
    """Claims of each hit were split anew, and met by question."""
    from belegwerk.config import PROSE
    from belegwerk.operators import answers

    lexicon = PROSE.__class__(**{**PROSE.__dict__, "positive": ("should",), "negative": ("never",)})
    texts = {1: "Honey should go to an infant daily.", 2: "Ships sail on. Honey never go to an infant daily.", 3: "Rest is best for all."}
    ranked = [(q, r, c, c * 10, texts[c]) for q, order in enumerate(((1, 2, 3), (3, 2, 1), (3, 1, 3))) for r, c in enumerate(order, 1)]
    hits = spark.createDataFrame(ranked, "query_id long, rank int, cidx long, doc_id long, text string")
    for rows in (hits, hits.drop("cidx")):
        found = answers.source_conflict(rows, lexicon)
        assert "SortMergeJoin" in found._jdf.queryExecution().executedPlan().toString()
        got = {r["query_id"]: (r["between"], r["docs"], r["claims"]) for r in found.collect()}
        assert got == {0: ([1, 2], [10, 20], [texts[1], texts[2][15:]]), 1: ([2, 3], [20, 10], [texts[2][15:], texts[1]])}


def test_terms_in_array_passes():
    """Terms were found text by text, each then looked up."""
    texts = ["Honey, an 'infant'  a_b _ __", None, "", "가나 다 x\x1cyz é\u0301t \U00020000\U00020001 \U0001f600", "a", "zz"]
    for some in (texts, texts[1:3], texts[4:5], []):
        found, ends = scores._runs(some)
        lists = [found[lo:hi].to_pylist() for _, lo, hi in scores._rows(ends)]
        assert lists == [[t for t in scores._TERM.findall(t or "") if len(t) > 1] for t in some]
    assert all(x == bool(scores._TERM.fullmatch(chr(i))) for i, x in enumerate(scores._in_words().tolist()))


def test_a_task_sends_on_the_best_alone(spark):
    """Each array pass sent on what was the best up to it, some thirty times as many rows as are the best."""
    texts = ["honey " * (i // 100 + 1) + f"for infants w{i % 13}" for i in range(1500)]
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "cidx long, text string").coalesce(1)
    queries = spark.createDataFrame([(0, "honey"), (1, "infants w7"), (2, "nothing")], "query_id long, text string")
    known = scores.vocabulary(chunks)
    got = scores.best(chunks, queries, known, 3).collect()
    assert len(got) <= 2 * 3 * 3
    every = {(r["query_id"], r["cidx"]): r for r in scores.best(chunks, queries, known, 1500).collect()}
    assert len(every) == 4500
    for name in ("dense", "bm25"):
        for q in range(3):
            want = sorted(range(1500), key=lambda c: (-round(every[q, c][name], 12), c))[:3]
            mine = {r["cidx"]: r[name] for r in got if r["query_id"] == q}
            assert set(want) <= set(mine)
            assert all(mine[c] == pytest.approx(every[q, c][name], abs=1e-12) for c in mine)


def test_sums_made_once_are_those_of_all(monkeypatch):
    texts = ["honey for infants", "infants, infants", "", "zz"]
    grams = sorted({g for t in texts for w in scores.words(t) for g in scores.grams(w)})
    scorer = scores._Scorer({"chunk_side": False, "texts": texts, "tokens": None, "avgdl": 1.0, "grams": grams, "idf": scores.np.ones(len(grams)), "terms": None, "term_idf": None})
    dense, error, _, _ = scorer.scores([*texts, None, "honey infants zz"], None, False)
    row, column = scores.np.nonzero(dense > -1)
    sums = scorer.exact(row, column)
    assert abs(sums - dense[row, column]).max() < error
    assert sums.reshape(dense.shape)[:2, :2].diagonal() == pytest.approx([1, 1])
    known = scores.np.array([1, 5, 9])
    pair = row * scorer.n + column
    assert (scorer.others(row, column, known, sums[known]) == sums).all() and (pair[known] == known).all()
    assert (scorer.others(row, column, known[:0], sums[:0]) == sums).all()


def test_bars_are_of_all_slices():
    """A bar was the k-th best of one array pass alone: late passes summed and sent on many rows for nothing."""
    np = scores.np
    top = np.full((2, 2), -np.inf)
    for column, value in (([0, 1], [0.5, 0.1]), ([0], [0.4]), ([0, 0], [0.3, 0.5])):
        scores._raise(top, np.array(column), np.array(value))
    assert top.min(axis=1).tolist() == [0.5, -np.inf]
    row, column = scores._ranking(np.array([7, 8, 9]), np.array([0, 0, 1]), np.array([0.5, 0.45, -1.0]), 2, top.min(axis=1))
    assert (row.tolist(), column.tolist()) == ([7, 9], [0, 1])
