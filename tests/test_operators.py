import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from belegwerk.config import KOREAN, Settings
from belegwerk.functions import text
from belegwerk.operators import accounting, answers, ask, chunking, dense, evaluate, graph, lexical, search


def test_spans_cover_the_body_and_stay_short():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["가", "나다. ", "요. ", "\n\n", "abc ", " ", "x"]) for _ in range(rng.randrange(0, 900)))
        got = list(chunking.spans(text, 400, 80))
        assert not text or (got[0][0] == 0 and got[-1][1] == len(text))
        for (a, b), (c, d) in zip(got, got[1:]):
            assert a < c <= b < d and b - a <= 800
        assert all(b > a for a, b in got)


def test_chunks_number_only_what_has_text(spark):
    docs = spark.createDataFrame([(1, "a" * 1000), (2, "   "), (3, None), (4, "짧다.")], "doc_id long, body string")
    got = chunking.chunk_documents(docs).orderBy("doc_id", "i").collect()
    assert [(r["chunk_id"], r["start"], r["end"]) for r in got] == [("1--0", 0, 400), ("1--1", 400, 800), ("1--2", 800, 1000), ("4--0", 0, 3)]


def okapi(corpus, query):
    n, avg = len(corpus), sum(map(len, corpus)) / len(corpus)
    df = {}
    for doc in corpus:
        for t in set(doc):
            df[t] = df.get(t, 0) + 1
    idf = {t: math.log(n - d + 0.5) - math.log(d + 0.5) for t, d in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in idf.items()}
    return [sum(idf.get(t, 0) * doc.count(t) * 2.5 / (doc.count(t) + 1.5 * (0.25 + 0.75 * len(doc) / avg)) for t in query) for doc in corpus]


def test_bm25_is_okapi_and_fills_zeros_in_order(spark):
    corpus = ["aa bb cc", "aa aa dd", "ee ff", "aa gg hh ii"]
    chunks = spark.createDataFrame(list(enumerate(corpus)), "cidx long, text string")
    queries = spark.createDataFrame([(1, "dd aa aa"), (2, "zz")], "query_id long, text string")
    scores = lexical.bm25_scores(lexical.build_index(chunks), queries)
    want = okapi([c.split() for c in corpus], "dd aa aa".split())
    got = {r["cidx"]: r["bm25"] for r in scores.where("query_id = 1").collect()}
    for i, w in enumerate(want):
        assert got.get(i, 0.0) == pytest.approx(w)
    full = lexical.top_ranked(lexical.zero_filled(scores, queries, chunks, 3), "bm25", 3, "rank")
    assert [r["cidx"] for r in full.where("query_id = 2").orderBy("rank").collect()] == [0, 1, 2]


def test_char_grams_stay_in_words(spark):
    got = spark.createDataFrame([("Ab c",)], "t string").select(dense.char_grams(F.col("t")).alias("g")).first()["g"]
    assert sorted(got) == sorted([" a", "ab", "b ", " ab", "ab ", " ab ", " c", "c ", " c "])


def test_block_top_k_is_exact(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, i % 5, v[i].tolist()) for i in range(60)], "id long, own long, v array<double>")
    got = {(r["query_id"], r["rank"]): r["cidx"] for r in dense.block_top_k(rows, rows, 3, block=16, apart=True).collect()}
    sims = v @ v.T
    for i in range(60):
        order = [j for j in np.argsort(-sims[i], kind="stable") if j % 5 != i % 5][:3]
        assert [got[(i, r)] for r in (1, 2, 3)] == order


def test_the_inverted_file_finds_most_neighbours(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.lit(0).alias("own"), dense.normalised(F.col("embedding")).alias("v"))
    asked = rows.where("id % 100 = 0")
    key = lambda df: {(r["query_id"], r["cidx"]) for r in df.collect()}
    exact, found = key(dense.block_top_k(asked, rows, 10)), key(dense.indexed_top_k(asked, rows, 10, block=64))
    assert len(exact & found) / len(exact) >= 0.9 and len(found) == len(exact)
    assert key(dense.indexed_top_k(asked, rows, 10, lists=8, probes=8, block=50)) == exact
    rng = np.random.default_rng(5)  # vectors in groups are found by few probes
    v = np.repeat(rng.normal(size=(40, 16)), 30, axis=0) + 0.2 * rng.normal(size=(1200, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    grouped = spark.createDataFrame([(i, 0, x.tolist()) for i, x in enumerate(v)], "id long, own int, v array<double>")
    centres, probes = dense.fit_lists(grouped, 34, 10)
    exact, found = key(dense.block_top_k(grouped, grouped, 10)), key(dense.indexed_top_k(grouped, grouped, 10))
    assert probes <= len(centres) // 3 and len(exact & found) / len(exact) >= 0.9
    assert dense.indexed_top_k(asked, rows.limit(0), 3).count() == 0


def test_rrf_ties_go_to_the_dense_rank(spark):
    d = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, cidx long, rank int")
    b = spark.createDataFrame([(1, 20, 1), (1, 11, 2)], "query_id long, cidx long, rank int")
    got = [r["cidx"] for r in search.rrf_fuse(d, b).orderBy("fused_rank").collect()]
    assert got == [11, 10, 20]


def test_search_switches_sources_off_before_ranking(spark):
    chunks = spark.createDataFrame([(0, "a", "fever in infants"), (1, "b", "fever medicine"), (2, "c", "sleep training")], "cidx long, doc_id string, text string")
    queries = spark.createDataFrame([(1, "fever")], "query_id long, text string")
    off = spark.createDataFrame([("a",)], "doc_id string")
    hits, signals = search.hybrid_search(chunks, queries, off)
    assert hits.where("rank = 1").first()["cidx"] == 1 and hits.where("doc_id = 'a'").count() == 0
    none, empty = search.hybrid_search(chunks, queries, chunks.select("doc_id"))
    assert none.count() == 0 and empty.select(search.refused().alias("r")).first()["r"] is True
    assert signals.select(search.refused().alias("r")).first()["r"] is False


def hashed(texts):
    out = np.zeros((len(texts), 32))
    for i, t in enumerate(texts):
        assert t.startswith(("query: ", "passage: "))
        for w in t.split(": ", 1)[1].split():
            out[i, sum(map(ord, w)) % 32] += 1
    return out


def test_search_with_an_encoder_and_a_stored_index(spark, tmp_path):
    texts = ["fever in infants", "fever medicine now", "sleep training tips", "sleep sleep sleep", "other words here"]
    chunks = spark.createDataFrame([((i, 0), f"d{i}", t) for i, t in enumerate(texts)], "cidx struct<doc:int,i:int>, doc_id string, text string")
    queries = spark.createDataFrame([(1, "infants fever"), (2, "sleep"), (3, "zzz")], "query_id long, text string")
    lexical.write_lexical(lexical.build_index(chunks), str(tmp_path / "lex"))
    index = lexical.read_lexical(spark, str(tmp_path / "lex"))
    encode = lambda rows, kind: dense.encoded(rows, hashed, kind)
    vectors = encode(chunks.select(F.col("cidx").alias("id"), "text"), "passage").withColumnRenamed("id", "cidx")
    hits, signals = search.hybrid_search(chunks, queries, index=index, vectors=vectors, encode=encode)
    again, _ = search.hybrid_search(chunks, queries, encode=encode)
    key = lambda r: (r["query_id"], r["rank"])
    assert sorted(map(tuple, hits.collect()), key=lambda r: r[:2]) == sorted(map(tuple, again.collect()), key=lambda r: r[:2])
    got = {key(r): r for r in hits.collect()}
    v, q = hashed([f"passage: {t}" for t in texts]), hashed(["query: infants fever", "query: sleep", "query: zzz"])
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = unit(q) @ unit(v).T
    for (qid, _), r in got.items():
        assert r["score"] == pytest.approx(sims[qid - 1, r["cidx"]["doc"]])
    assert got[(1, 1)]["doc_id"] == "d0" and got[(2, 1)]["doc_id"] == "d3"
    tops = {r["query_id"]: r for r in signals.collect()}
    assert tops[1]["dense_top"] == pytest.approx(sims[0].max()) and tops[3]["bm25_top"] == 0
    # a reranker decides the order, and its top the refusal
    rerank = lambda rows: rows.select("query_id", "cidx", (F.col("cidx.doc") / 100.0).alias("rerank_score"))
    hits, signals = search.hybrid_search(chunks, queries, index=index, vectors=vectors, encode=encode, rerank=rerank)
    for qid in (1, 2, 3):
        docs = [r["cidx"]["doc"] for r in hits.where(f"query_id = {qid}").orderBy("rank").collect()]
        assert docs == sorted(docs, reverse=True)
    assert signals.select(search.refused("sbert").alias("r")).where("r").count() == 3


def test_bm25_by_shuffle_and_by_broadcast_agree(spark, monkeypatch):
    chunks = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 7}" for j in range(i + 1))) for i in range(30)], "cidx long, text string")
    queries = spark.createDataFrame([(1, "w1 w2 w2"), (2, "w0"), (3, "none")], "query_id long, text string")
    index = lexical.build_index(chunks)
    rows = lambda: {(r["query_id"], r["cidx"]): round(r["bm25"], 9) for r in lexical.bm25_scores(index, queries).collect()}
    a = rows()
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 0)
    assert rows() == a and a


def _tagged(text):
    """A stand-in for an analyzer: each word with the tag that follows its slash."""
    words_ = F.regexp_extract_all(text, F.lit(r"(\S+)"), 1)
    return F.transform(words_, lambda w: F.struct(F.split_part(w, F.lit("/"), F.lit(1)).alias("form"), F.split_part(w, F.lit("/"), F.lit(2)).alias("tag")))


def test_analyzer_hooks(spark):
    one = lambda t, c: spark.createDataFrame([(t,)], "t string").select(c(F.col("t")).alias("x")).first()["x"]
    tokens = lambda t: one(t, lambda c: text.tokens(c, _tagged))
    assert tokens("fever/NNG a/NNG in/JKB 7/SN see/VV") == ["fever", "7", "see"] and tokens("In/JKB a/JX") == ["In", "JKB", "a", "JX"]
    assert one("fever/NNG 7/SN", lambda c: text.content_tokens(c, _tagged)) == ["fever"]
    cut = lambda t: one(t, lambda c: text.starts_midclause(c, _tagged))
    assert cut("있고/EC 심하면 병원에") and not cut("있다/EF 그렇다") and cut("x/ETM 더") is False and not cut("그리고 쉰다")
    assert one("있고 심하면", lambda c: text.starts_midclause(c)) is False
    good = "있고/EC 심하면 병원에 간다고 합니다."
    assert one(good, lambda c: text.is_wellformed(c)) and not one(good, lambda c: text.is_wellformed(c, _tagged))


def test_generation_and_its_fallbacks(spark):
    said = {1: '{"sentences": [{"text": "It may pass.", "citations": [1, 7]}]}', 2: "Plain words.[1] And more.[9]", 3: '{"sentences": []}', 4: None}
    rows = [(q, r, "a", "The infant has a fever today. Call the doctor about the fever now.", "T", "open" if r == 1 else "arr") for q in said for r in (1, 2)]
    evidence = spark.createDataFrame(rows, "query_id long, rank int, doc_id string, text string, title string, lic_class string")
    queries = spark.createDataFrame([(q, "infant fever") for q in said], "query_id long, text string")
    prompt = {r["query_id"]: r["prompt"] for r in answers.prompts(evidence, queries).collect()}[1]
    assert "[1] (T) The infant" in prompt and "[2] (T)〔원문 그대로만 인용〕 The infant" in prompt and prompt.endswith("infant fever\n") and "{evidence}" not in prompt
    texts = spark.createDataFrame(list(said.items()), "query_id long, text string")
    got = {r["query_id"]: r for r in answers.generate(evidence, queries, lambda asked: asked.join(texts, "query_id")).collect()}
    assert [got[q]["mode"] for q in (1, 2, 3, 4)] == ["llm", "llm", "llm", "extractive"]
    assert got[1]["answer"] == f"It may pass.[1] {KOREAN.advice}" and got[2]["answer"] == f"Plain words. And more.[1] {KOREAN.advice}"  # a mark after the stop hides its end
    assert got[3]["answer"] == text.NO_EVIDENCE and got[3]["sentences"] == [] and got[4]["answer"].startswith("The infant has a fever today.[1]")
    alone = {r["query_id"]: r["answer"] for r in answers.generate(evidence, queries).collect()}
    assert set(alone.values()) == {got[4]["answer"]}


def test_ask_refuses_twice_and_verifies_the_rest(spark):
    body = "아기 열이 나면 해열제를 먹여도 된다고 안내한다. 물을 자주 마시게 하는 것이 좋다고 한다."
    chunks = spark.createDataFrame([(0, "a", body), (1, "b", "sleep training for older children takes time."), *((i, "b", f"filler number {i}") for i in range(2, 7))], "cidx long, doc_id string, text string")
    docs = spark.createDataFrame([("a", "열", "p", "2024", "CC BY"), ("b", "잠", "p", "2024", None)], "doc_id string, title string, publisher string, year string, license string")
    queries = spark.createDataFrame([(1, "아기 열이 나면"), (2, "qqq zzz"), (3, "sleep training")], "query_id long, text string")
    model = lambda asked: asked.select("query_id", F.when(F.col("query_id") == 3, '{"sentences": [{"text": "No numbers.", "citations": []}]}').alias("text"))
    nli = lambda pairs: pairs.select("pair_id", F.lit("contradiction").alias("label"))
    out = ask.ask(chunks, docs, queries, llm=model, nli=nli)
    got = {r["query_id"]: r for r in out.answers.collect()}
    assert [got[q]["refused"] for q in (1, 2, 3)] == [False, True, True]
    assert got[2]["answer"] == text.NOT_FOUND and got[3]["answer"] == text.NOT_ANSWERED and got[1]["mode"] == "extractive" and "[1]" in got[1]["answer"]
    assert {r["doc_id"] for r in out.citations.collect()} == {"a"} and {r["query_id"] for r in out.verification.collect()} == {1}
    assert {r["status"] for r in out.verification.collect()} <= {"grounded", "advisory"}  # quotes can't contradict
    assert out.evidence.where("query_id = 1 and rank = 1").first()["lic_label"] == text.LICENSE_LABELS["open"] and out.conflicts.count() == 0


def test_evaluation_by_labelled_questions(spark):
    texts = {"a": "The infant has a fever today and rests. Call the doctor about the fever soon.", "b": "Sleep training for older children takes some time.", "c": "Honey is for children over one year of age only."}
    chunks = spark.createDataFrame([(i, d, t) for i, (d, t) in enumerate(texts.items())] + [(9, "d", "filler about ships"), (10, "d", "filler about ports")], "cidx long, doc_id string, text string")
    rows = [(1, "infant fever doctor", ["a"], False), (2, "honey year", ["b", "c"], False), (3, "sleep training", ["zzz"], False), (4, "qqq xxx", [], True), (5, "ships", [], True), (6, "www", ["a"], False)]
    q = spark.createDataFrame(rows, "query_id long, question string, relevant_docs array<string>, is_negative boolean")
    r = evaluate.evaluate(q, chunks).first()
    assert (r["n_positive"], r["n_negative"], r["n_answered"]) == (4, 2, 3)
    assert r["refusal_recall"] == 0.5 and r["false_refusal"] == 0.25
    hits, _ = search.hybrid_search(chunks, q.select("query_id", F.col("question").alias("text")), k=5)
    docs = {i: [x["doc_id"] for x in hits.where(f"query_id = {i}").orderBy("rank").collect()] for i, *_ in rows}
    best = [min((docs[i].index(d) + 1 for d in rel if d in docs[i]), default=None) for i, _, rel, neg in rows if not neg]
    assert r["recall"] == sum(b is not None for b in best) / 4 and r["mrr"] == pytest.approx(sum(1 / b for b in best if b) / 4)
    assert r["contradiction"] == 0 and r["uncited"] == 0 and 0 < r["mean_similarity"] <= 1


def test_sources_that_are_not_there(spark):
    changes = spark.createDataFrame([("a", False), ("x", False), ("x", True)], "doc_id string, enabled boolean")
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    assert [r["doc_id"] for r in accounting.unknown_sources(changes, docs).collect()] == ["x"]
    assert [r["doc_id"] for r in accounting.toggle_sources(docs.limit(0), changes, docs).collect()] == ["a"]


def test_intermediate_tables_go(spark):
    import os

    from belegwerk.plans import store

    there = lambda: set(os.listdir(store.shared_dir(spark).removeprefix("file:"))) if os.path.isdir(store.shared_dir(spark).removeprefix("file:")) else set()
    before = there()
    df = store.kept_alone(spark, lambda: store.written(store.written(spark.range(5), "one").where("id > 1"), "two"), "result")
    assert df.count() == 3 and {n.split("-")[0] for n in there() - before} == {"result"}
    store.discard(spark)
    assert not there()
    assert store.written(spark.range(2), "again").count() == 2


def test_nli_labels_are_merged(spark):
    evidence = spark.createDataFrame([(1, 1, "Some long evidence text about one thing."), (1, 2, "Another text about a second thing.")], "query_id long, rank int, text string")
    s = spark.createDataFrame([(1, 0, "A claim on both of them.", [1, 2]), (1, 1, "A claim on the second.", [2])], "query_id long, sidx int, text string, citations array<int>")
    nli = lambda pairs: pairs.select("pair_id", F.when(F.col("pair_id.rank") == 1, "contradiction").otherwise("entailment").alias("label"))
    got = {r["sidx"]: (r["status"], r["entailment"]) for r in answers.verify_sentences(s, evidence, nli=nli).collect()}
    assert got == {0: ("contradiction", "contradiction"), 1: ("grounded", "entailment")}


def test_graph_switches_to_documents(spark):
    rows = [(i, f"c{i}", i % 3, "아기 꿀 섭취 시기 돌 이후 가능하다." if i % 2 else "아기 꿀 섭취 시기 돌 이후 금지.", [math.cos(i / 50), math.sin(i / 50)]) for i in range(9)]
    all_ = spark.createDataFrame(rows, "cidx long, chunk_id string, doc_id long, text string, v array<double>")
    docs = spark.createDataFrame([(d, f"D{d}", None, None, None) for d in range(4)], "doc_id long, title string, publisher string, license string, url string")
    nodes, edges = graph.knowledge_graph(docs, all_.drop("v"), all_.select("cidx", "doc_id", "v"))
    kinds = {r["kind"]: r["n"] for r in graph.graph_stats(edges).collect()}
    want = sum(1 for a in rows for b in rows if a[0] < b[0] and a[2] != b[2] and a[0] % 2 != b[0] % 2)
    assert kinds["member"] == 9 and kinds["conflict"] == want and nodes.count() == 13
    assert graph.neighbours(edges, "doc:0").count() == 3
    nodes, edges = graph.knowledge_graph(docs, all_.drop("v"), all_.select("cidx", "doc_id", "v"), settings=Settings(graph_limit=8))
    assert nodes.count() == 4 and {r["kind"] for r in edges.collect()} == {"xsim"}


def test_conflicts_meet_by_their_rare_words(spark):
    rng = random.Random(7)
    stock = ["함께", "모두", "자주"] + [f"말{i}" for i in range(25)]
    rows = []
    for i in range(60):
        claim = " ".join(rng.sample(stock, 7)) + (" 가능하다." if rng.random() < 0.5 else " 금지.")
        rows.append((i, i % 7, claim))
    chunks = spark.createDataFrame(rows, "cidx long, doc_id long, text string")
    vectors = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(60)], "cidx long, v array<double>")
    got = {(r["a"], r["b"]) for r in graph.conflict_edges(chunks, vectors).collect()}
    toks = {i: {w.rstrip(".") for w in t.split()} for i, _, t in rows}
    want = {(a, b) for a, da, ta in rows for b, db, tb in rows if a < b and da != db and ("금지" in ta) != ("금지" in tb) and len(toks[a] & toks[b]) >= 4}
    assert got == want and len(want) > 5


def test_passages_are_found_without_white_space(spark):
    docs = spark.createDataFrame([(1, "one two\nthree  four five"), (2, "nothing"), (3, None), (4, "x one  twothree y")], "doc_id long, body string")
    asked = spark.createDataFrame([(1, "two three"), (2, "four"), (3, "  "), (4, "missing here"), (5, "two three")], "query_id long, text string")
    want = {(1, 1), (1, 4), (2, 1), (5, 1), (5, 4)}
    for most in (100, 1):
        assert {(r["query_id"], r["doc_id"]) for r in accounting.containing(asked, docs, most).collect()} == want


def test_refusal_prefers_the_rerank_score(spark):
    s = spark.createDataFrame([(1, 0.9, 5.0, 0.01), (1, 0.0, 0.0, 0.5), (1, 0.0, 0.0, None)], "n_hits int, dense_top double, bm25_top double, rerank_top double")
    assert [r["r"] for r in s.select(search.refused().alias("r")).collect()] == [True, False, True]


def test_extractive_answers_stay_in_the_first_document(spark):
    hits = spark.createDataFrame(
        [(1, 1, "a", "The infant has a fever today. Call the doctor about the fever now."), (1, 2, "b", "Fever fever fever is elsewhere described."), (1, 3, "a", "The infant has a fever today. Sleep is good for it.")],
        "query_id long, rank int, doc_id string, text string",
    )
    queries = spark.createDataFrame([(1, "infant fever")], "query_id long, text string")
    got = answers.extractive_answer(hits, queries, answers.token_overlap).orderBy("sidx").collect()
    assert [(r["text"], r["citations"]) for r in got] == [("The infant has a fever today.", [1]), ("Call the doctor about the fever now.", [1]), ("Sleep is good for it.", [3])]
    full = answers.with_advice(answers.extractive_answer(hits, queries, answers.token_overlap), KOREAN).first()
    assert full["sentences"][-1]["text"] == KOREAN.advice and full["answer"].startswith("The infant has a fever today.[1]")


def test_verification_statuses(spark):
    evidence = spark.createDataFrame([(1, 1, "생후 육개월 이전 아기에게 꿀을 먹이면 안 된다. 다른 문장이다.")], "query_id long, rank int, text string")
    rows = [(1, 0, "생후 육개월 이전 아기에게 꿀을 먹여도 된다고 할 수 있다.", [1]), (1, 1, "생후 육개월 이전 아기에게 꿀을 먹이면 안 된다.", [1, 9]), (1, 2, "전문의와 상담하시기 바랍니다.", []), (1, 3, "근거 없는 주장입니다.", [7]), (1, 4, "짧다", [1])]
    s = spark.createDataFrame(rows, "query_id long, sidx int, text string, citations array<int>")
    got = {r["sidx"]: r for r in answers.verify_sentences(s, evidence).collect()}
    assert {k: r["status"] for k, r in got.items()} == {0: "contradiction", 1: "grounded", 2: "advisory", 3: "uncited"}
    assert got[1]["citations"] == [1] and not got[1]["contradiction"] and got[3]["warn"] and not got[2]["warn"]


def test_source_conflict_needs_two_documents(spark):
    say = ("아기 꿀 섭취 시기 돌 이후 가능하다.", "아기 꿀 섭취 시기 돌 이후 금지.")
    hits = spark.createDataFrame([(1, 1, "a", say[0]), (1, 2, "a", say[1]), (1, 3, "b", say[1])], "query_id long, rank int, doc_id string, text string")
    got = answers.source_conflict(hits).collect()
    assert [(r["between"], r["docs"]) for r in got] == [([1, 3], ["a", "b"])]


def test_graph_vectors_and_edges(spark):
    v = spark.createDataFrame([(0, 1, [1.0, 0.0]), (1, 1, [0.0, 2.0]), (2, 2, [1.0, 1.0]), (3, 3, [-1.0, 0.0])], "cidx long, doc_id long, v array<double>")
    docs = {r["doc_id"]: r["v"] for r in graph.doc_vectors(v).collect()}
    assert docs[1] == pytest.approx([math.sqrt(0.5)] * 2)
    edges = {(r["a"], r["b"]): r["w"] for r in graph.doc_knn(graph.doc_vectors(v), 1).collect()}
    assert edges[(1, 2)] == pytest.approx(1.0)


def test_accounting(spark):
    s = spark.createDataFrame([(1, 0, [1, 1, 2]), (1, 1, [1])], "query_id long, sidx int, citations array<int>")
    e = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "query_id long, rank int, doc_id string")
    counts = accounting.citation_counts(s, e)
    assert {r["doc_id"]: r["cited"] for r in counts.collect()} == {"a": 2, "b": 1}
    assert {r["doc_id"]: r["share"] for r in accounting.contribution_share(counts).collect()} == {"a": 0.667, "b": 0.333}
    docs = spark.createDataFrame([("a", "x"), ("c", "w")], "doc_id string, title string")
    got = accounting.source_catalog(docs, counts, spark.createDataFrame([("c",)], "doc_id string")).collect()
    assert [(r["doc_id"], r["cited"], r["enabled"]) for r in got] == [("a", 2, True), ("c", 0, False)]


def test_metrics(spark):
    hits = spark.createDataFrame([(1, 2, "a"), (1, 3, "b"), (2, 1, "z")], "query_id long, rank int, doc_id string")
    rel = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "query_id long, doc_id string")
    r = accounting.recall_mrr(hits, rel).first()
    assert (r["n"], r["recall"], r["mrr"]) == (2, 0.5, 0.25)
    o = spark.createDataFrame([(1, True, True), (2, True, False), (3, False, False)], "query_id long, is_negative boolean, refused boolean")
    assert tuple(accounting.refusal_rates(o).first()) == (0.5, 0.0)


def test_domain_filter(spark):
    body = "영유아 모유 " * 100
    docs = spark.createDataFrame([(1, body), (2, "x" * 500), (3, "영유아 모유")], "doc_id long, body string")
    assert [r["doc_id"] for r in accounting.domain_filter(docs, KOREAN, Settings()).collect()] == [1]
