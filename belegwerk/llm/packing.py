"""Packing: concatenate all token ids and cut into fixed windows.

Pass one tokenises once and writes each document's ids with its place inside its partition.
Only partition totals (one row per partition) meet on the driver, whose prefix sums are the
partitions' global offsets. Pass two reads the written ids and cuts each document where window
borders fall inside it. No row moves between tasks and no document is gathered with others.

The tail after the last full window is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ship import map_arrow
from .common import written
from .tokens import encoder

WINDOW = 4096
END_ID = 2


def _tokenise(name: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        words, part, at = encoder(name), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                piece = batch.slice(lo, 1024)
                ids, lengths = [], []
                for x in words.encode(piece.column(1)):
                    lengths.append(len(x) + 1)
                    ids.append(np.append(x, np.uint32(end_id)).astype("<u4"))
                lengths = np.array(lengths, dtype=np.int64)
                wide = any(len(x) and x.max() > 65535 for x in ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column(0),
                        pa.array([part] * len(ids), pa.int32()),
                        pa.array(at + np.cumsum(lengths) - lengths, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        pa.array([x.astype("<u4" if wide else "<u2").tobytes() for x in ids], pa.binary()),
                        pa.array([wide] * len(ids), pa.bool_()),
                    ],
                    ["doc_id", "part", "local_start", "doc_tokens", "ids", "wide"],
                )
                at += int(lengths.sum())

    return run


def tail_cuts(total: int, window: int) -> list[int]:
    """Global starts of the sequences after the last full window, and the end."""
    at, cuts = total // window * window, []
    while at < total:
        cuts.append(at)
        at += 1 << ((total - at).bit_length() - 1)
    return [*cuts, total]


def _cut(total: int, window: int):
    full = total // window
    tail = np.array(tail_cuts(total, window), dtype=np.int64)

    def run(batches):
        for batch in batches:
            cols = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            for doc, base, start, wide, raw in zip(*(batch.column(i) for i in range(5))):
                ids = np.frombuffer(raw.as_buffer(), dtype="<u4" if wide.as_py() else "<u2").astype("<u4")
                g, n = base.as_py() + start.as_py(), len(ids)
                inner = np.arange(g // window + 1, min((g + n - 1) // window, full) + 1, dtype=np.int64) * window
                cuts = np.unique(np.concatenate([[g], inner, tail[(tail > g) & (tail < g + n)], [g + n]]))
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    k = a // window
                    seq = k if k < full else full + int(np.searchsorted(tail, a, side="right")) - 1
                    cols["doc_id"].append(doc.as_py())
                    cols["start"].append(a - g)
                    cols["length"].append(b - a)
                    cols["ids_crc32"].append(zlib.crc32(ids[a - g : b - g]))
                    cols["doc_tokens"].append(n)
                    cols["sequence_id"].append(seq)
                    cols["offset"].append(a - (k * window if k < full else int(tail[seq - full])))
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in cols.items()})

    return run


def packed(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """``docs(doc_id, text, ...)`` -> one row per piece of a document in a sequence.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A document is its
    token ids, then ``end_id``; null and empty texts are the end id alone. Sequences hold
    ``window`` ids, but for those of the tail, whose lengths are falling powers of two. Every id
    lies in one piece; ids of rows that repeat a doc_id, or have none, are packed row by row.
    ``tokenizer`` names a file of the public tokenizers. Other columns are ignored; an empty
    table gives no pieces.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = written(
        map_arrow(source, _tokenise(tokenizer, end_id), "doc_id long, part int, local_start long, doc_tokens long, ids binary, wide boolean"),
        "pack-ids",
    )
    # one row per partition of the input: as many as the scan has tasks, not as many as documents
    totals = sorted((r["part"], r["n"]) for r in ids.groupBy("part").agg(F.sum("doc_tokens").alias("n")).collect())
    bases, at = [], 0
    for part, n in totals:
        bases.append((part, at))
        at += n
    spark = docs.sparkSession
    base = spark.createDataFrame(bases, "part int, base long")
    placed = ids.join(F.broadcast(base), "part").select("doc_id", "base", "local_start", "wide", "ids")
    return map_arrow(
        placed, _cut(at, window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
