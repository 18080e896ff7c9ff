import zipfile

from pyspark.sql import functions as F

from belegwerk.sources import articles, documents, feedback
from belegwerk.streaming import gate


def test_documents_of_a_folder(spark, tmp_path):
    (tmp_path / "a.MD").write_text("title: A: b\nyear: 1\nyear: 2\n---\nBody\n12\n---\nrest", encoding="utf-8")
    with zipfile.ZipFile(tmp_path / "b.hwpx", "w") as z:
        z.writestr("Contents/section0.xml", "<p>글</p><p>둘</p>")
    (tmp_path / "b.hwpx.meta").write_text("license: CC BY\n", encoding="utf-8")
    (tmp_path / "c.hwpx").write_bytes(b"broken")
    docs, skipped = documents.read_documents(spark, str(tmp_path))
    got = {r["doc_id"]: r for r in docs.collect()}
    assert got["a"]["meta"] == {"title": "A: b", "year": "2"} and got["a"]["body"] == "Body\n---\nrest"
    assert got["b"]["meta"] == {"license": "CC BY", "title": "b"} and got["b"]["body"] == "글 둘"
    assert [r["path"].rsplit("/", 1)[1] for r in skipped.collect()] == ["c.hwpx"]


def test_index_refuses_another_kind(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "doc_id long, body string")
    documents.write_index(df, df, str(tmp_path / "i"), "tfidf")
    assert documents.read_index(spark, str(tmp_path / "i"), "tfidf")[0].count() == 1
    try:
        documents.read_index(spark, str(tmp_path / "i"), "sbert")
        raise AssertionError("read")
    except ValueError:
        pass


def test_articles(spark):
    xml = "<a><CNTNTS_SJ><![CDATA[ 열 ]]></CNTNTS_SJ><cntntsCl><CNTNTS_CL_NM><![CDATA[정의]]></CNTNTS_CL_NM><CNTNTS_CL_CN><![CDATA[a  b\nc]]></CNTNTS_CL_CN></cntntsCl><cntntsCl><CNTNTS_CL_NM><![CDATA[참고문헌]]></CNTNTS_CL_NM><CNTNTS_CL_CN><![CDATA[x]]></CNTNTS_CL_CN></cntntsCl></a>"
    r = articles.article(spark.createDataFrame([(1, xml)], "sn long, xml string"), "xml").first()
    assert (r["title"], r["body"]) == ("열", "정의\na b c")
    lst = "<l><cntntsList><CNTNTS_SJ><![CDATA[A]]></CNTNTS_SJ><CNTNTS_SN><![CDATA[12]]></CNTNTS_SN></cntntsList><cntntsList></cntntsList></l>"
    assert [tuple(r) for r in articles.article_list(spark.createDataFrame([(lst,)], "xml string"), "xml").collect()] == [("12", "A")]


def test_feedback_and_questions(spark, tmp_path):
    rows = spark.createDataFrame([("q" * 600, "a", "up", "c", "llm")], "question string, answer string, rating string, comment string, mode string").withColumn("ts", F.lit(None).cast("string"))
    feedback.append_feedback(rows, str(tmp_path / "f"))
    assert len(spark.read.json(str(tmp_path / "f")).first()["question"]) == 500
    back = feedback.from_log(feedback.log_lines(rows).union(spark.createDataFrame([("noise",)], "value string"))).collect()
    assert [(r["rating"], len(r["question"])) for r in back] == [("up", 500)]
    (tmp_path / "q.jsonl").write_text('{"question": "a", "relevant_doc": "d"}\n\n{"question": "b", "relevant_docs": [], "is_negative": true}\n')
    got = {r["question"]: (r["relevant_docs"], r["is_negative"]) for r in feedback.read_questions(spark, str(tmp_path / "q.jsonl")).collect()}
    assert got == {"a": (["d"], False), "b": ([], True)}


def test_state_tables(spark, tmp_path):
    path = str(tmp_path / "s")
    assert feedback.read_state(spark, path, "doc_id string").count() == 0
    feedback.write_state(spark.createDataFrame([("a",)], "doc_id string"), path)
    feedback.write_state(feedback.read_state(spark, path, "doc_id string").union(spark.createDataFrame([("b",)], "doc_id string")), path)
    assert feedback.read_state(spark, path, "doc_id string").count() == 2


def test_questions_that_repeat_stay_apart(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"question": "a", "relevant_doc": "d"}\n{"question": "a", "relevant_doc": "e"}\n')
    got = feedback.read_questions(spark, str(tmp_path / "q.jsonl")).collect()
    assert len({r["query_id"] for r in got}) == 2 and {tuple(r["relevant_docs"]) for r in got} == {("d",), ("e",)}


def test_a_broken_state_leaves_the_one_before(spark, tmp_path):
    path = str(tmp_path / "s")
    for names in (["a"], ["a", "b"], ["c"]):
        feedback.write_state(spark.createDataFrame([(n,) for n in names], "doc_id string"), path)
    spark.createDataFrame([("x",)], "doc_id string").write.parquet(f"{path}/version-000000000009-broken")
    (tmp_path / "s/version-000000000009-broken/_SUCCESS").unlink()
    assert [r["doc_id"] for r in feedback.read_state(spark, path, "doc_id string").collect()] == ["c"]
    feedback.write_state(spark.createDataFrame([("d",)], "doc_id string"), path)
    assert [r["doc_id"] for r in feedback.read_state(spark, path, "doc_id string").collect()] == ["d"]


def test_two_files_of_one_stem(spark, tmp_path):
    (tmp_path / "a.md").write_text("first", encoding="utf-8")
    with zipfile.ZipFile(tmp_path / "a.hwpx", "w") as z:
        z.writestr("Contents/section0.xml", "<p>other</p>")
    docs, skipped = documents.read_documents(spark, str(tmp_path))
    assert [(r["doc_id"], r["body"]) for r in docs.collect()] == [("a", "first")]
    assert [r["path"].rsplit("/", 1)[1] for r in skipped.collect()] == ["a.hwpx"]


def test_missing_libraries_and_programs_skip_the_file(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 broken")
    (tmp_path / "b.hwp").write_bytes(b"broken")
    (tmp_path / "c.md").write_text("good", encoding="utf-8")
    docs, skipped = documents.read_documents(spark, str(tmp_path))
    assert [r["doc_id"] for r in docs.collect()] == ["c"] and {r["path"][-5:] for r in skipped.collect()} == {"a.pdf"[-5:], "b.hwp"[-5:]}


def test_pages_and_sections_are_joined(monkeypatch, spark):
    monkeypatch.setitem(documents.READERS, "pdf", lambda b: ["one", "two"])
    files = spark.createDataFrame([("x/a.pdf", "pdf", bytearray(b"x"))], "path string, ext string, content binary")
    assert documents.BETWEEN["pdf"].join(documents.READERS["pdf"](b"")) == "one\n\ntwo" and documents.extracted(files).count() == 1


def test_collected_articles_are_read_again(spark, tmp_path):
    folder = tmp_path / "pack"
    folder.mkdir()
    (folder / "portal_9_old.md").write_text("gone", encoding="utf-8")
    (folder / "mine.md").write_text("title: mine\n---\nstays", encoding="utf-8")
    body = "영유아 모유 이유식 이야기. " * 60
    rows = [("1", "열: 이 나는/아기", body), ("2", "다른 글", "x" * 900)]
    kept = documents.collect_articles(spark.createDataFrame(rows, "sn string, title string, body string"), str(folder), "공공누리", "https://portal.example")
    assert [r["sn"] for r in kept.collect()] == ["1"]
    docs, skipped = documents.read_documents(spark, str(folder))
    got = {r["doc_id"]: r for r in docs.collect()}
    assert set(got) == {"mine", "portal_1_열_이_나는아기"} and skipped.count() == 0
    new = got["portal_1_열_이_나는아기"]
    assert new["meta"]["title"] == rows[0][1] and new["meta"]["license"] == "공공누리" and new["body"] == body.strip()


def test_feedback_stream_appends_each_row_once(spark, tmp_path):
    lines = tmp_path / "log"
    lines.mkdir()
    for i in range(2):
        (lines / f"{i}.txt").write_text(f'noise\n12:00 [FEEDBACK] {{"question": "{"q" * 600}{i}", "rating": "up"}}\n', encoding="utf-8")
        q = feedback.stream_feedback(feedback.from_log(spark.readStream.text(str(lines))), str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True)
        q.awaitTermination()
    got = spark.read.json(str(tmp_path / "out")).collect()
    assert len(got) == 2 and all(len(r["question"]) == 500 and r["ts"] for r in got)


def drive(*pieces):
    held, passed, refused, out = "", False, False, []
    for i, piece in enumerate(pieces):
        held, passed, refused, events = gate.step(held, passed, refused, piece, i == len(pieces) - 1)
        out += events
    return out


def test_gate_refuses_blank_answers_and_ends_short_ones():
    assert drive("  ") == [("refused", "")] and drive("") == [("refused", "")] and drive(" ", "\n", "") == [("refused", "")]
    assert drive("Yes") == [("delta", "Yes")] and drive(" " * 20) == [("delta", " " * 20)]
    assert drive("  __NO_ANSWER__") == [("refused", "")] and drive("__NO_ANSWER__ but") == [("refused", "")]
    assert gate.cites("a [2]", 2) and not gate.cites("a [3] [0]", 2) and not gate.cites("[99999999999999]", 2)


def test_gate_holds_back_a_split_sentinel():
    held, passed, refused, out = "", False, False, []
    for piece in ("__NO_", "ANSWER", "__"):
        held, passed, refused, events = gate.step(held, passed, refused, piece, piece == "__")
        out += events
    assert out == [("refused", "")]
    held, passed, refused, out = "", False, False, []
    for i, piece in enumerate(("He", "llo, ", "this is it", "!")):
        held, passed, refused, events = gate.step(held, passed, refused, piece, i == 3)
        out += events
    assert "".join(d for _, d in out) == "Hello, this is it!" and out[0][1] == "Hello, this is it"


def test_gate_keeps_requests_of_a_bucket_apart(spark, tmp_path):
    """A call and a state for each request took 10 ms each. Requests go on over batches."""
    shape = "request_id string, seq long, token string, last boolean, n_evidence int"
    parts = [
        [("a", 0, "A long answer ", False, 1), ("b", 1, "rt", False, 1), ("b", 0, "sho", False, 1), ("c", 0, "__NO_ANS", False, 1)],
        [("a", 1, "ends.[1]", True, 1), ("b", 2, "", True, 1), ("c", 1, "WER__", True, 1), ("d", 0, "one [1]", True, 1)],
    ]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = gate.gate(spark.readStream.schema(shape).parquet(str(tmp_path / "in")), buckets=1)
        assert "bucket" in str(stream._jdf.queryExecution().logical())
        stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out")).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [
        ("a", 0, "delta", "A long answer "), ("a", 1, "delta", "ends.[1]"), ("a", 2, "meta", ""),
        ("b", 0, "delta", "short"), ("b", 1, "refused", ""), ("c", 0, "refused", ""), ("d", 0, "delta", "one [1]"), ("d", 1, "meta", ""),
    ]
