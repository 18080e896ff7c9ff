"""Dense retrieval: character n-gram TF-IDF vectors, cosines and exact top-k by blocks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..plans.ship import map_arrow, ship
from ..plans.store import least_hashed, written

MAX_FEATURES = 50_000  # fixed value


def cosine(a: Column, b: Column) -> Column:
    """Dot product of normalised vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, 1.0).otherwise(norm))


def char_grams(text: Column) -> Column:
    """2- to 4-grams inside words padded by a space on either side, lower-cased; of a padded word
    no longer than n there is one n-gram, the word, and no longer ones."""
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")

    def grams(w: Column) -> Column:
        p = F.concat(F.lit(" "), w, F.lit(" "))
        size = F.length(p)

        def of(n: int) -> Column:
            return F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substr(p, i, F.lit(n)))

        return F.concat(of(2), of(3), F.when(size > 3, of(4)).otherwise(F.array().cast("array<string>")))

    return F.flatten(F.transform(words, grams))


def encoded(rows: DataFrame, model: Callable[[list[str]], np.ndarray], kind: str = "passage", asymmetric: bool = True, batch: int = 256) -> DataFrame:
    """``rows(id, text)`` -> id, v: normalised vectors of a bi-encoder, for questions (``kind``
    query) or for what they are asked of (passage). ``model`` maps a list of texts to a matrix and
    is loaded where it is called; asymmetric models are told the kind by a prefix."""
    prefix = f"{kind}: " if asymmetric else ""

    def run(batches):
        for part in batches:
            for lo in range(0, part.num_rows, batch):
                some = part.slice(lo, batch)
                v = np.asarray(model([prefix + (t or "") for t in some.column(1).to_pylist()]), dtype=np.float64)
                norm = np.linalg.norm(v, axis=1, keepdims=True)
                v = v / np.where(norm == 0, 1.0, norm)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(list(v), pa.list_(pa.float64()))], ["id", "v"])

    id_type = rows.schema["id"].dataType.simpleString()
    return map_arrow(rows.select("id", F.col("text").cast("string").alias("text")), run, f"id {id_type}, v array<double>")


#: Rows of a block of vectors at most, and rows of either side whose products are one matrix.
STRIP, TILE = 65_536, (512, 4096)


def _strip_top(k: int, apart: bool, left: pa.Table, right: pa.Table) -> pa.Table:
    """The k best of the right strip for each left row; products are made tile by tile."""
    lid, lown, lv = _unpacked(left)
    rid, rown, rv = _unpacked(right)
    l_place, r_place = _places(lid, rid)
    order = np.argsort(r_place)
    rid, r_place, rv = rid.take(pa.array(order)), r_place[order], rv[order]
    l_own, r_own = _places(lown, rown.take(pa.array(order))) if apart else (None, None)
    out = []
    for lo in range(0, len(lv), TILE[0]):
        mine = slice(lo, lo + TILE[0])
        n = len(lv[mine])
        rows, columns, values = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        bar = np.full(n, -np.inf)
        for at in range(0, len(rv), TILE[1]):
            there = slice(at, at + TILE[1])
            sims = lv[mine] @ rv[there].T
            drop = l_place[mine, None] == r_place[None, there]
            if apart:
                drop |= l_own[mine, None] == r_own[None, there]
            sims[drop] = -np.inf
            floor = bar
            if at == 0 and k < sims.shape[1]:
                floor = np.partition(sims, sims.shape[1] - k, axis=1)[:, sims.shape[1] - k]
            # sums in another order differ in the last places: what is equal but for those is a tie
            r, c = np.nonzero((sims > -np.inf) & (sims > (floor + (-1e-12 if at == 0 else 5e-13))[:, None]))
            rows, columns, values = np.append(rows, r), np.append(columns, c + at), np.append(values, np.round(sims[r, c], 12))
            best = np.lexsort((columns, -values, rows))
            rows, columns, values = rows[best], columns[best], values[best]
            first = np.flatnonzero(np.diff(rows, prepend=-1))
            place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
            last = place == k - 1
            bar[rows[last]] = values[last]
            rows, columns, values = (x[place < k] for x in (rows, columns, values))
        out.append((rows + lo, columns, values))
    rows, columns, values = (np.concatenate(x) for x in zip(*out))
    return pa.table([lid.take(pa.array(rows)), rid.take(pa.array(columns)), pa.array(values)], ["query_id", "cidx", "dense"])


def _block_top(k: int, apart: bool):
    """(block rows of either side) -> the k best of the right block for each left row."""

    def run(batches):
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1)):
                sides = (pa.Table.from_struct_array(x.values) for x in (left, right))
                yield from _strip_top(k, apart, *sides).to_batches()

    return run


def _unpacked(rows: pa.Table) -> tuple[pa.Array, pa.Array, np.ndarray]:
    ids, own, v = (pa.concat_arrays(rows.column(c).chunks) for c in ("id", "own", "v"))
    return ids, own, v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.num_rows, -1)


def _places(a: pa.Array, b: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers that stand to each other as the values of both arrays do; values may be structs."""
    plain = lambda v: tuple(map(plain, v.values())) if isinstance(v, dict) else v
    x, y = (list(map(plain, array.to_pylist())) for array in (a, b))
    number = {v: i for i, v in enumerate(sorted({*x, *y}))}
    return np.array([number[v] for v in x]), np.array([number[v] for v in y])


def block_top_k(queries: DataFrame, base: DataFrame, k: int, block: int = STRIP, apart: bool = False) -> DataFrame:
    """Exact k nearest rows of ``base(id, own, v)`` for each row of ``queries(id, own, v)``, by
    cosine of normalised vectors, ties by id; never a row itself, nor with ``apart`` one of the
    same own. -> query_id, cidx, dense, rank. Ids may be numbers, strings or structs.

    Both sides are cut into strips by hash, of ``block`` rows at most; a task has one pair of strips,
    and only its k best per row go on. Queries x rows is the work that the question has; a row is
    moved once for each strip of the other side, some eight times up to 500,000 rows.
    """
    ship(queries.sparkSession)
    sizes = [df.count() for df in (queries, base)]
    n_left, n_right = (max(1, -(-n // block), min(8, n // 4096)) for n in sizes)
    if n_left == 1:  # few questions: strips of the base are the tasks
        n_right = max(n_right, min(48, sizes[1] // 4096))

    def strips(df: DataFrame, name: str, n: int, other: str, m: int) -> DataFrame:
        each = df.select("id", "own", F.col("v").cast("array<double>").alias("v"), F.pmod(F.xxhash64("id"), F.lit(n)).alias(name))
        return each.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)).cast("array<bigint>"))).groupBy("l", "r")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return _strip_top(k, apart, left, right).cast(none.schema) if left.num_rows and right.num_rows else none

    shape = "query_id {}, cidx {}, dense double".format(*(df.schema["id"].dataType.simpleString() for df in (queries, base)))
    none = to_arrow_schema(StructType.fromDDL(shape)).empty_table()  # its fields may be null, as those of the result
    best = strips(queries, "l", n_left, "r", n_right).cogroup(strips(base, "r", n_right, "l", n_left)).applyInArrow(run, shape)
    order = Window.partitionBy("query_id").orderBy(F.col("dense").desc(), "cidx")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``queries(query_id, v)``, ``vectors(cidx, v)`` of a model -> query_id, cidx, dense, rank: the k
    nearest chunks of each question. Exact."""
    unlike = lambda df, name, side: df.select(F.struct(F.lit(side).alias("side"), F.col(name).alias("id")).alias("id"), F.lit(side).alias("own"), "v")
    found = block_top_k(unlike(queries, "query_id", 0), unlike(vectors, "cidx", 1), k)
    return found.select(F.col("query_id.id").alias("query_id"), F.col("cidx.id").alias("cidx"), "dense", "rank")


def fit_lists(vectors: DataFrame, lists: int, k: int, recall: float = 0.95, sample: int = 20_000, rounds: int = 10, seed: int = 1) -> tuple[np.ndarray, int]:
    """Centres of an inverted file, by k-means in numpy over the ``sample`` rows of ``vectors(id, v)``
    of least hash, and how many lists to probe: so many that of the k nearest sampled rows of a
    thousand sampled ones a share of ``recall`` is in them. The index is fitted on this bounded
    sample, but holds every row."""
    rows = least_hashed(vectors.select("id", "v").withColumn("h", F.xxhash64("id")), sample, "id").select("v").collect()
    x = np.array([r["v"] for r in rows], dtype=np.float64)
    if not len(x):
        return np.zeros((1, 1)), 1
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.where(norm > 0, norm, 1.0), centres)
    near, asked = (x @ centres.T).argmax(axis=1), x[:1000]
    sims = asked @ x.T
    sims[np.arange(len(asked)), np.arange(len(asked))] = -np.inf
    best = np.argsort(-sims, axis=1)[:, : max(1, min(k, len(x) - 1))]
    rank = np.argsort(np.argsort(-(asked @ centres.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(rank, near[best], axis=1).ravel())
    return centres, int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1


def _listed(rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """``rows(id, own, v)`` with each of its ``probes`` nearest lists."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            sims = flat.reshape(batch.num_rows, -1) @ shared.value.T
            near = np.argsort(-sims, axis=1, kind="stable")[:, :probes]
            at = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(at) for i in range(3)), pa.array(near.ravel().astype(np.int32))], ["id", "own", "v", "list"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "own")]
    return map_arrow(rows.select("id", "own", F.col("v").cast("array<double>").alias("v")), run, f"id {kinds[0]}, own {kinds[1]}, v array<double>, list int")


def indexed_top_k(
    queries: DataFrame, base: DataFrame, k: int, lists: int | None = None, probes: int | None = None, block: int = 1024, apart: bool = False, sample: int = 20_000, recall: float = 0.95
) -> DataFrame:
    """As ``block_top_k``, but each query is compared with the rows of its nearest lists only: an
    inverted file, by default of as many lists as the root of the rows, of which as many are probed
    as ``recall`` takes on a sample. Every row is in one list; a list of any size is dealt in blocks.
    Vectors without structure need most lists for a high recall: none is a sure gain.
    """
    lists = lists or max(1, int(base.count() ** 0.5))
    centres, fitted = fit_lists(base, lists, k, recall, sample)
    probes = min(len(centres), probes or fitted)
    if centres.shape == (1, 1):
        return block_top_k(queries, base, k, block, apart)

    def blocks(rows: DataFrame, name: str) -> DataFrame:
        sizes = rows.groupBy("list").agg(F.ceil(F.count("*") / block).alias("parts"))
        part = F.pmod(F.xxhash64("id"), "parts").alias("part")
        dealt = rows.join(F.broadcast(sizes), "list").select("list", part, F.struct("id", "own", "v").alias("row"))  # a row for each list
        return dealt.groupBy("list", "part").agg(F.collect_list("row").alias(f"{name}_rows")).drop("part")

    pairs = blocks(_listed(queries, centres, probes), "l").join(blocks(written(_listed(base, centres, 1), "lists"), "r"), "list").select("l_rows", "r_rows")
    kinds = (df.schema["id"].dataType.simpleString() for df in (queries, base))
    best = map_arrow(pairs, _block_top(k, apart), "query_id {}, cidx {}, dense double".format(*kinds))
    order = Window.partitionBy("query_id").orderBy(F.col("dense").desc(), "cidx")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
