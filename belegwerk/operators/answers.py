"""Evidence, extractive answers, verification of sentences, and conflicts between sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, KOREAN, Lexicon, Settings
from ..functions import text as T
from ..plans.store import written


def evidence_payload(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """``hits`` with their documents' title, publisher, year, license, its class and the label of
    that; the title falls back to the document id."""
    meta = docs.select("doc_id", "title", "publisher", "year", "license")
    out = hits.join(meta, "doc_id", "left").withColumn("lic_class", T.license_class(F.col("license")))
    out = out.withColumn("lic_label", T.license_label(F.col("lic_class")))
    return out.withColumn("title", F.coalesce("title", F.col("doc_id").cast("string")))


def numbered_evidence(evidence: DataFrame) -> DataFrame:
    """(query_id, prompt): one numbered line for each hit, marked where it may only be quoted."""
    line = F.concat(
        F.lit("["), F.col("rank"), F.lit("] ("), F.col("title"), F.lit(")"), F.when(T.allow_rewrite(F.col("lic_class")), "").otherwise(T.QUOTE_ONLY), F.lit(" "), F.col("text")
    )
    parts = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return evidence.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("prompt"))


def extractive_answer(
    hits: DataFrame, queries: DataFrame, similarity: Callable[[Column, Column], Column], most: int = 3, analyzer: T.Analyzer | None = None
) -> DataFrame:
    """``hits(query_id, rank, doc_id, text)`` -> query_id, sidx, text, citations.

    Sentences of the first hit's document only, complete ones before any others, without repeats;
    the ``most`` similar to the question, in source order, each citing its hit.
    ``similarity`` maps (question, sentence) columns to a score; ``analyzer`` tells sentences that
    begin in mid-clause.
    """
    top = hits.where("rank = 1").select("query_id", F.col("doc_id").alias("top_doc"))
    pool = hits.join(top, "query_id").where("doc_id = top_doc")

    def sentences(strict: bool) -> DataFrame:
        each = pool.select("query_id", "rank", F.posexplode(T.clean_sentences(F.col("text"))).alias("pos", "s")).where(F.length("s") > 15)
        each = each.where(T.is_wellformed(F.col("s"), analyzer)) if strict else each
        first = Window.partitionBy("query_id", T.squash(F.col("s"))).orderBy("rank", "pos")
        return each.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")

    strict = sentences(True)
    relaxed = sentences(False).join(strict.select("query_id").distinct(), "query_id", "left_anti")
    scored = strict.unionByName(relaxed).join(queries.select("query_id", F.col("text").alias("question")), "query_id")
    scored = scored.withColumn("sim", similarity(F.col("question"), F.col("s")))
    best = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "rank", "pos")
    place = Window.partitionBy("query_id").orderBy("rank", "pos")
    chosen = scored.withColumn("n", F.row_number().over(best)).where(F.col("n") <= most).withColumn("sidx", F.row_number().over(place))
    return chosen.select("query_id", "sidx", F.col("s").alias("text"), F.array("rank").alias("citations"))


_SENTENCES = "array<struct<text:string,citations:array<int>>>"


def advised(sentences: Column, lexicon: Lexicon = KOREAN) -> Column:
    """An array of sentences, an advice appended where there are some and none speaks of one."""
    spoken = F.exists(sentences, lambda s: s["text"].contains(lexicon.advisory[0]))
    extra = F.array(F.struct(F.lit(lexicon.advice).alias("text"), F.array().cast("array<int>").alias("citations")))
    return F.when(spoken | (F.size(sentences) == 0), sentences).otherwise(F.concat(sentences, extra))


def _gathered(answers: DataFrame) -> DataFrame:
    """Answers as arrays of sentences; an answer's sentences are few."""
    sents = F.transform(F.array_sort(F.collect_list(F.struct("sidx", "text", "citations"))), lambda s: F.struct(s["text"].alias("text"), s["citations"].cast("array<int>").alias("citations")))
    return answers.groupBy("query_id").agg(sents.alias("sentences"))


def with_advice(answers: DataFrame, lexicon: Lexicon = KOREAN) -> DataFrame:
    """Answers as arrays of sentences, an advice appended where none speaks of one."""
    out = _gathered(answers).withColumn("sentences", advised(F.col("sentences"), lexicon))
    return out.withColumn("answer", T.render(F.col("sentences")))


#: What a model is asked; {evidence} and {question} are filled in. Another wording is a parameter.
PROMPT = """Answer the question from the numbered evidence alone, for a lay reader, in short sentences.
Give every sentence the numbers of the evidence it rests on. Copy evidence marked as quote-only word
for word. Do not speak of the evidence itself. Where it does not answer the question, or the question
belongs to another field, give no sentences. Medical matters end in a sentence, without numbers, that
advises to ask a professional.
Reply with JSON only: {"sentences": [{"text": "...", "citations": [1, 2]}]}

[evidence]
{evidence}

[question]
{question}
"""


def prompts(evidence: DataFrame, queries: DataFrame, template: str = PROMPT) -> DataFrame:
    """(query_id, prompt): the template with the numbered evidence and the question in place."""
    before, rest = template.split("{evidence}", 1)
    between, after = rest.split("{question}", 1)
    listed = numbered_evidence(evidence).select("query_id", F.col("prompt").alias("listed"))
    out = queries.join(listed, "query_id")
    return out.select("query_id", F.concat(F.lit(before), "listed", F.lit(between), F.col("text"), F.lit(after)).alias("prompt"))


def generate(
    evidence: DataFrame,
    queries: DataFrame,
    llm: Callable[[DataFrame], DataFrame] | None = None,
    similarity: Callable[[Column, Column], Column] | None = None,
    lexicon: Lexicon = KOREAN,
    template: str = PROMPT,
    analyzer: T.Analyzer | None = None,
) -> DataFrame:
    """``evidence(query_id, rank, doc_id, text, title, lic_class)``, ``queries(query_id, text)`` ->
    query_id, mode, sentences, answer, for every question with evidence.

    ``llm`` takes (query_id, prompt) and returns (query_id, text), null where it failed: those
    questions, and all without an ``llm``, get extractive answers. Its text is read as JSON, or as
    plain text with ``[n]`` marks where it is none. No sentences are an answer that there is no
    evidence; any others end in an advice. The model is called once.
    """
    asked = evidence.groupBy("query_id").agg(F.count("*").cast("int").alias("n"))
    if llm:
        said = written(llm(prompts(evidence, queries, template)).select("query_id", F.col("text").alias("said")), "said").where("said is not null")
        read = said.join(asked, "query_id").withColumn("sentences", T.parse_llm_json(F.col("said"), F.col("n")))
        read = read.withColumn("sentences", F.coalesce("sentences", T.parse_citations(F.col("said"), F.col("n"))))
        made = read.select("query_id", F.lit("llm").alias("mode"), F.col("sentences").cast(_SENTENCES).alias("sentences"))
        left = evidence.join(said.select("query_id"), "query_id", "left_anti")
    else:
        made, left = None, evidence
    taken = _gathered(extractive_answer(left, queries, similarity or token_overlap, analyzer=analyzer))
    none = F.array().cast(_SENTENCES)
    plain = left.select("query_id").distinct().join(taken, "query_id", "left").select("query_id", F.lit("extractive").alias("mode"), F.coalesce(F.col("sentences").cast(_SENTENCES), none).alias("sentences"))
    out = plain if made is None else made.unionByName(plain)
    out = out.withColumn("sentences", advised(F.col("sentences"), lexicon))
    return out.withColumn("answer", F.when(F.size("sentences") == 0, T.NO_EVIDENCE).otherwise(T.render(F.col("sentences"))))


def token_overlap(a: Column, b: Column) -> Column:
    """Similarity without a model: shared tokens by the cosine of the sets."""
    x, y = F.array_distinct(T.tokens(a)), F.array_distinct(T.tokens(b))
    return F.size(F.array_intersect(x, y)) / F.sqrt(F.greatest(F.size(x), F.lit(1)) * F.greatest(F.size(y), F.lit(1)).cast("double"))


def _claims(df: DataFrame, key: list[str], lexicon: Lexicon) -> DataFrame:
    """Claims of ``df(*key, text)`` with place, polarity and content tokens."""
    each = df.select(*key, F.posexplode(T.split_claims(F.col("text"))).alias("pos", "claim"))
    return each.withColumn("pol", T.polarity(F.col("claim"), lexicon)).withColumn("toks", T.content_tokens(F.col("claim")))


def negation_conflict(pairs: DataFrame, lexicon: Lexicon = KOREAN, least: int = 2) -> DataFrame:
    """``pairs(pair_id, sentence, evidence)`` -> pair_id, conflict: the evidence claim that shares
    most content tokens, the first of equals, says the opposite."""
    mine = pairs.select("pair_id", T.polarity(F.col("sentence"), lexicon).alias("ps"), T.content_tokens(F.col("sentence")).alias("st"))
    theirs = _claims(pairs.select("pair_id", F.col("evidence").alias("text")), ["pair_id"], lexicon)
    over = mine.join(theirs, "pair_id").withColumn("ov", F.size(F.array_intersect("st", "toks"))).where(F.col("ov") > 0)
    best = over.groupBy("pair_id").agg(F.max_by(F.struct("ov", "pol", "ps"), F.struct("ov", -F.col("pos"))).alias("b"))
    found = best.select("pair_id", ((F.col("b.ov") >= least) & (F.col("b.ps") != 0) & (F.col("b.pol") != 0) & (F.col("b.ps") != F.col("b.pol"))).alias("conflict"))
    return pairs.select("pair_id").join(found, "pair_id", "left").fillna(False, ["conflict"])


def verify_sentences(
    sentences: DataFrame,
    evidence: DataFrame,
    similarity: Callable[[Column, Column], Column] = token_overlap,
    lexicon: Lexicon = KOREAN,
    settings: Settings = DEFAULT,
    nli: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """``sentences(query_id, sidx, text, citations)``, ``evidence(query_id, rank, text)`` -> query_id,
    sidx, sentence, citations, similarity, warn, status, contradiction, entailment.

    Citations out of range go, sentences under 8 code points too. A verbatim quote of cited
    evidence can't contradict it. ``nli`` maps (pair_id, sentence, evidence) to (pair_id, label).
    """
    n = evidence.groupBy("query_id").agg(F.count("*").alias("n"))
    s = sentences.withColumn("sentence", T.strip(F.col("text"))).where(F.length("sentence") >= 8).join(n, "query_id")
    s = s.withColumn("cites", F.filter("citations", lambda c: c.between(1, F.col("n")))).select("query_id", "sidx", "sentence", "cites")
    pairs = s.select("query_id", "sidx", "sentence", F.explode(F.array_distinct("cites")).alias("rank")).join(
        evidence.select("query_id", "rank", F.col("text").alias("evidence")), ["query_id", "rank"]
    )
    pairs = pairs.withColumn("pair_id", F.struct("query_id", "sidx", "rank"))
    pairs = pairs.withColumn("sim", similarity(F.col("sentence"), F.col("evidence"))).withColumn("quoted", T.squash(F.col("evidence")).contains(T.squash(F.col("sentence"))))
    pairs = pairs.join(negation_conflict(pairs.select("pair_id", "sentence", "evidence"), lexicon), "pair_id")
    pairs = pairs.join(nli(pairs.select("pair_id", "sentence", "evidence")), "pair_id", "left") if nli else pairs.withColumn("label", F.lit(None).cast("string"))
    judged = pairs.groupBy("query_id", "sidx").agg(
        F.max("sim").alias("sim"),
        F.bool_or("quoted").alias("verbatim"),
        F.bool_or(F.col("conflict") | F.coalesce(F.col("label") == "contradiction", F.lit(False))).alias("against"),
        F.bool_or(F.coalesce(F.col("label") == "contradiction", F.lit(False))).alias("nli_no"),
        F.bool_or(F.coalesce(F.col("label") == "entailment", F.lit(False))).alias("nli_yes"),
    )
    out = s.join(judged, ["query_id", "sidx"], "left")
    cited = F.size("cites") > 0
    against = cited & ~F.coalesce("verbatim", F.lit(False)) & F.coalesce("against", F.lit(False))
    advisory = ~cited & T.is_advisory(F.col("sentence"), lexicon)
    return out.select(
        "query_id",
        "sidx",
        "sentence",
        F.col("cites").alias("citations"),
        F.round("sim", 3).alias("similarity"),
        F.when(cited, (F.col("sim") < settings.sim_warn) | against).otherwise(~advisory).alias("warn"),
        F.when(cited, F.when(against, "contradiction").otherwise("grounded")).when(advisory, "advisory").otherwise("uncited").alias("status"),
        against.alias("contradiction"),
        F.when(cited & ~F.col("verbatim"), F.when(F.col("nli_no"), "contradiction").when(F.col("nli_yes"), "entailment")).alias("entailment"),
    )


def source_conflict(hits: DataFrame, lexicon: Lexicon = KOREAN, least: int = 3) -> DataFrame:
    """``hits(query_id, rank, doc_id, text)`` -> query_id, between, docs, claims: the first pair of
    claims of different documents, in order of hits and places, of opposite polarity with enough
    shared content tokens. A text is split once, by its cidx where hits have one, and two texts meet
    once, however many questions they answer."""
    key = "cidx" if "cidx" in hits.columns else "text"
    listed = hits.groupBy("query_id").agg(F.collect_list(F.struct("rank", "doc_id", F.col(key).alias("key"))).alias("h"))  # hits of a query are few
    after = lambda a: F.filter("h", lambda b: (a["rank"] < b["rank"]) & (a["doc_id"] != b["doc_id"]))
    pairs = listed.select("query_id", F.explode(F.flatten(F.transform("h", lambda a: F.transform(after(a), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("p"))
    pairs = written(pairs.select("query_id", F.array("p.a.rank", "p.b.rank").alias("between"), F.array("p.a.doc_id", "p.b.doc_id").alias("docs"), F.col("p.a.key").alias("x"), F.col("p.b.key").alias("y")), "pairs")
    texts = hits.groupBy(F.col(key).alias("key")).agg(F.any_value("text").alias("text"))
    claims = written(_claims(texts, ["key"], lexicon).where("pol <> 0"), "claims")
    a, b = claims.alias("a"), claims.alias("b")
    met = pairs.select("x", "y").distinct().join(a, F.col("x") == F.col("a.key")).join(b, (F.col("y") == F.col("b.key")) & (F.col("a.pol") == -F.col("b.pol")))
    met = met.where(F.size(F.array_intersect("a.toks", "b.toks")) >= least)
    first = met.groupBy("x", "y").agg(F.min_by(F.array("a.claim", "b.claim"), F.struct(F.col("a.pos").alias("p"), F.col("b.pos").alias("q"))).alias("claims"))
    found = pairs.hint("merge").join(first, ["x", "y"])  # pairs of all questions do not go to the driver
    return found.groupBy("query_id").agg(F.min_by(F.struct("between", "docs", "claims"), "between").alias("v")).select("query_id", "v.between", "v.docs", "v.claims")
