"""Documents into chunks that keep their source offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..plans.ship import map_arrow

# fixed values
_BOUNDARY = re.compile(r"(?:다\.|요\.|\.)\s|\n\s*\n")
_STOPS = ("\n\n", "다.", ". ")


def spans(text: str, size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Start and end of each chunk. An end prefers the last stop in the second half of its
    window, then the first boundary of the next ``size`` code points. The next start is after the
    first boundary of the overlap; without one there is no overlap."""
    n, at = len(text), 0
    while at < n:
        end = at + size
        if end >= n:
            yield at, n
            return
        stop = max(text.rfind(s, at, end) for s in _STOPS) - at
        if stop > size // 2:
            end = at + stop + 2
        elif found := _BOUNDARY.search(text, end, min(n, end + size)):
            end = found.end()
        yield at, end
        if end >= n:
            return
        low = max(end - overlap, at + 1)
        found = _BOUNDARY.search(text, low, end)
        at = found.end() if found else end


def _chunked(size: int, overlap: int):
    def run(batches):
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                i = 0
                for a, b in spans(body or "", size, overlap):
                    text = body[a:b].strip()
                    if text:
                        for column, value in zip(rows, (doc, i, a, b, text)):
                            column.append(value)
                        i += 1
            kinds = (batch.schema.field(0).type, pa.int32(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], ["doc_id", "i", "start", "end", "text"])

    return run


def chunk_documents(docs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """``docs(doc_id, body)`` -> chunk_id, doc_id, i, start, end, text.

    Spans are taken before the text is stripped; a blank chunk gets no number. Works row by row,
    so nothing is shuffled.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = map_arrow(docs.select("doc_id", "body"), _chunked(settings.chunk_size, settings.chunk_overlap), f"doc_id {kind}, i int, start int, end int, text string")
    return out.select(F.concat(F.col("doc_id").cast("string"), F.lit("--"), F.col("i")).alias("chunk_id"), "doc_id", "i", "start", "end", "text")


def source_slice(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Each chunk with the passage of its document that it covers."""
    return chunks.join(docs.select("doc_id", "body"), "doc_id").select(
        "chunk_id", "doc_id", "start", "end", F.substr("body", F.col("start") + 1, F.col("end") - F.col("start")).alias("passage")
    )
