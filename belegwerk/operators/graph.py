"""The graph of documents and chunks: members, nearest neighbours and conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, KOREAN, Lexicon, Settings
from ..plans.store import written
from .answers import _claims
from .dense import block_top_k, cosine, normalised


def doc_nodes(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``docs(doc_id, title, publisher, license, url)`` with the number of chunks."""
    sizes = chunks.groupBy("doc_id").agg(F.count("*").alias("size"))
    return docs.join(sizes, "doc_id", "left").select(
        F.concat(F.lit("doc:"), F.col("doc_id")).alias("id"), F.lit("doc").alias("type"), F.coalesce("title", F.col("doc_id").cast("string")).alias("label"), "doc_id",
        F.coalesce("publisher", F.lit("")).alias("publisher"), F.coalesce("license", F.lit("")).alias("license"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("size", F.lit(0)).alias("size"),
    )


def chunk_nodes(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.concat(F.lit("chunk:"), F.col("chunk_id")).alias("id"), F.lit("chunk").alias("type"), F.left("text", F.lit(38)).alias("label"), "doc_id")


def member_edges(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.concat(F.lit("doc:"), F.col("doc_id")).alias("s"), F.concat(F.lit("chunk:"), F.col("chunk_id")).alias("t"), F.lit("member").alias("kind"))


def doc_vectors(vectors: DataFrame) -> DataFrame:
    """``vectors(doc_id, v)`` -> doc_id, v: the normalised mean of the normalised vectors. Sums
    combine by (document, place), so a large document is no large group. Documents without
    chunks have no vector."""
    each = vectors.select("doc_id", F.posexplode(normalised(F.col("v"))).alias("i", "x"))
    mean = each.groupBy("doc_id", "i").agg(F.avg("x").alias("x"))
    whole = mean.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))
    return whole.select("doc_id", normalised(F.col("v")).alias("v"))


def _undirected(near: DataFrame) -> DataFrame:
    return near.groupBy(F.least("query_id", "cidx").alias("a"), F.greatest("query_id", "cidx").alias("b")).agg(F.max("dense").alias("w"))


def doc_knn(doc_vecs: DataFrame, k: int = DEFAULT.knn) -> DataFrame:
    """Undirected edges (a, b, w) to the k nearest documents."""
    rows = doc_vecs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("own"), "v")
    return _undirected(block_top_k(rows, rows, k))


def chunk_knn(vectors: DataFrame, k: int = DEFAULT.knn) -> DataFrame:
    """Undirected edges (a, b, w) to the k nearest chunks of other documents."""
    rows = vectors.select(F.col("cidx").alias("id"), F.col("doc_id").alias("own"), normalised(F.col("v")).alias("v"))
    return _undirected(block_top_k(rows, rows, k, apart=True))


def conflict_edges(chunks: DataFrame, vectors: DataFrame, lexicon: Lexicon = KOREAN, least: int = 4, settings: Settings = DEFAULT) -> DataFrame:
    """``chunks(cidx, doc_id, text)``, ``vectors(cidx, v)`` -> (a, b): chunks of different documents
    with similar vectors and claims of opposite polarity that share ``least`` content tokens.

    Claims that share ``least`` tokens share one of all but ``least - 1`` of either's tokens, so each
    meets by its rarest ones: the most common tokens of a claim are no place to meet.
    """
    claims = _claims(chunks, ["cidx", "doc_id"], lexicon).where("pol <> 0").where(F.size("toks") >= least)
    claims = written(claims.select("cidx", "doc_id", "pos", "pol", "toks"), "claims")
    words = claims.select("cidx", "doc_id", "pos", "pol", "toks", F.explode("toks").alias("tok"))
    spread = written(words.groupBy("tok").agg(F.count("*").alias("df")), "claim-words")
    rare = F.slice(F.array_sort(F.collect_list(F.struct("df", "tok"))), F.lit(1), F.greatest(F.count("*").cast("int") - least + 1, F.lit(1)))
    places = words.join(spread, "tok").groupBy("cidx", "doc_id", "pos", "pol").agg(F.first("toks").alias("toks"), rare.alias("rare"))
    places = written(places.select("cidx", "doc_id", "pos", "pol", "toks", F.explode("rare.tok").alias("tok")), "claim-places")
    a, b = places.alias("a"), places.alias("b")
    opposed = (F.col("a.tok") == F.col("b.tok")) & (F.col("a.cidx") < F.col("b.cidx")) & (F.col("a.doc_id") != F.col("b.doc_id")) & (F.col("a.pol") == -F.col("b.pol"))
    met = a.join(b, opposed & (F.size(F.array_intersect("a.toks", "b.toks")) >= least))
    pairs = met.select(F.col("a.cidx").alias("a"), F.col("b.cidx").alias("b")).distinct()
    unit = vectors.select("cidx", normalised(F.col("v")).alias("v"))
    out = pairs.join(unit.select(F.col("cidx").alias("a"), F.col("v").alias("x")), "a").join(unit.select(F.col("cidx").alias("b"), F.col("v").alias("y")), "b")
    return out.where(cosine(F.col("x"), F.col("y")) >= settings.conflict_similarity).select("a", "b")


def knowledge_graph(docs: DataFrame, chunks: DataFrame, vectors: DataFrame, lexicon: Lexicon = KOREAN, settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """``docs``, ``chunks(cidx, chunk_id, doc_id, text)``, ``vectors(cidx, doc_id, v)`` -> (nodes(id,
    type, label, doc_id, publisher, license, url, size), edges(s, t, kind, w)).

    Up to ``graph_limit`` chunks the graph holds documents and chunks, with member, xsim and
    conflict edges; a larger corpus is shown by its documents and their xsim edges alone.
    """
    nodes = doc_nodes(docs, chunks)
    if chunks.limit(settings.graph_limit + 1).count() > settings.graph_limit:
        near = doc_knn(doc_vectors(vectors), settings.knn)
        name = lambda c: F.concat(F.lit("doc:"), F.col(c).cast("string"))
        return nodes, near.select(name("a").alias("s"), name("b").alias("t"), F.lit("xsim").alias("kind"), F.round("w", 3).alias("w"))
    nodes = nodes.unionByName(chunk_nodes(chunks), allowMissingColumns=True)
    named = chunks.select("cidx", F.concat(F.lit("chunk:"), F.col("chunk_id")).alias("name"))

    def between(pairs: DataFrame, kind: str, w: Column) -> DataFrame:
        ends = pairs.join(named.select(F.col("cidx").alias("a"), F.col("name").alias("s")), "a").join(named.select(F.col("cidx").alias("b"), F.col("name").alias("t")), "b")
        return ends.select("s", "t", F.lit(kind).alias("kind"), w.alias("w"))

    none = F.lit(None).cast("double")
    edges = member_edges(chunks).withColumn("w", none)
    edges = edges.unionByName(between(chunk_knn(vectors, settings.knn), "xsim", F.round("w", 3)))
    return nodes, edges.unionByName(between(conflict_edges(chunks, vectors.select("cidx", "v"), lexicon, settings=settings), "conflict", none))


def graph_stats(edges: DataFrame) -> DataFrame:
    return edges.groupBy("kind").agg(F.count("*").alias("n"))


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    """The nodes one edge away."""
    return edges.where(F.col("s") == node).select(F.col("t").alias("id")).union(edges.where(F.col("t") == node).select("s")).distinct()
