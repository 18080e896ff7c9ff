"""Streams of answer tokens: a gate that holds back a refusal, and running citation counts."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import SENTINEL
from ..plans.ship import ship

OUT = "request_id string, seq long, event string, data string"
_STATE = "opened string"  # JSON of pairs: a request, and what is kept of it
_COLUMNS = ("seq", "token", "last", "n_evidence", "failed", "fallback")
_MARK = re.compile(r"\[(\d+)\]")


def step(held: str, passed: bool, refused: bool, piece: str, last: bool) -> tuple[str, bool, bool, list[tuple[str, str]]]:
    """One token delta: text is held until it is as long as the sentinel, then it flows, blank or
    not. The sentinel is a refusal, and so is an answer that ends before it flows and is blank."""
    if refused:
        return "", passed, True, []
    if passed:
        return "", True, False, [("delta", piece)] if piece else []
    held += piece
    if len(held) >= len(SENTINEL) or last:
        if held.lstrip().startswith(SENTINEL) or (last and len(held) < len(SENTINEL) and not held.strip()):
            return "", False, True, [("refused", "")]
        return "", True, False, [("delta", held)]
    return held, False, False, []


def cites(text: str, n_evidence: int) -> bool:
    """Whether an answer cites any of its evidence."""
    return any(len(m) < 10 and 1 <= int(m) <= n_evidence for m in _MARK.findall(text))


def gate(tokens: DataFrame, idle_ms: int | None = None, buckets: int = 2048) -> DataFrame:
    """Streaming ``tokens(request_id, seq, token, last, ...)`` -> request_id, seq, event, data, in
    append mode.

    Events of a request: deltas, then meta, or a refusal, also after deltas that have gone out.
    With a column ``n_evidence`` an answer that cites none of its evidence ends in a refusal. With
    columns ``failed`` and ``fallback`` a row that reports a failure ends the request with the whole
    fallback answer, under the same test, in place of what was held; a null one is a refusal.
    State is the text of each open request; an event's place in its request makes a repeated write
    recognisable. A request that says nothing for ``idle_ms`` is dropped; leave it None for a
    finite stream, which would else wait for time to pass.
    Requests meet in ``buckets``, each one state and one call, since a call costs some 10 ms however
    little it does. A bucket's rows of a batch are in memory together; a checkpoint fixes the number.
    """
    known = {c for c in tokens.columns if c in _COLUMNS and (c != "fallback" or "failed" in tokens.columns)}
    counted = "n_evidence" in known

    def cited(text: str, n) -> bool:
        return not counted or cites(text, 0 if pd.isna(n) else int(n))

    def request(rows: list[tuple], before: list | None, say: Callable[[int, str, str], None]) -> list | None:
        """Says a request's events; what is kept of it while it is open."""
        held, full, nxt, passed, refused = before or ("", "", 0, False, False)
        for _, token, last, n, failed, fallback in sorted(rows, key=lambda r: r[0]):
            if failed == True:  # noqa: E712  nulls too
                if not refused and isinstance(fallback, str) and cited(fallback, n):
                    say(nxt, "delta", fallback)
                    say(nxt + 1, "meta", "")
                elif not refused:
                    say(nxt, "refused", "")
                return None
            piece = token if isinstance(token, str) else ""
            full += piece
            held, passed, refused, events = step(held, passed, refused, piece, bool(last))
            for event, data in events:
                say(nxt, event, data)
                nxt += 1
            if last:
                if not refused:
                    say(nxt, "meta" if cited(full, n) else "refused", "")
                return None
        return [held, full, nxt, passed, refused]

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState):
        opened = dict(json.loads(state.get[0])) if state.exists else {}
        now, out, rows = state.getCurrentProcessingTimeMs() if idle_ms else 0, [], {}
        for frame in frames:
            columns = [frame[c].tolist() if c in known else [None] * len(frame) for c in _COLUMNS]
            for name, *row in zip(frame["request_id"].tolist(), *columns):
                rows.setdefault(name, []).append(row)
        for name, mine in rows.items():
            *before, _ = opened.pop(name, [None])
            left = request(mine, before, lambda *event: out.append((name, *event)))
            if left:
                opened[name] = [*left, now]
        if idle_ms:
            opened = {k: v for k, v in opened.items() if v[-1] + idle_ms > now}
        if opened:
            state.update((json.dumps(list(opened.items())),))
            if idle_ms:
                state.setTimeoutDuration(min(v[-1] for v in opened.values()) + idle_ms - now)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["request_id", "seq", "event", "data"])

    ship(tokens.sparkSession)
    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    dealt = tokens.withColumn("bucket", F.pmod(F.xxhash64("request_id"), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInPandasWithState(run, OUT, _STATE, "append", timeout)


def citation_stream(events: DataFrame) -> DataFrame:
    """Streaming ``events(doc_id, ...)`` -> running counts by document, in complete mode."""
    return events.groupBy("doc_id").agg(F.count("*").alias("cited"))


def windowed_citations(events: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An extension: counts in event-time windows, late events up to a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", every), "doc_id").agg(F.count("*").alias("cited"))


def ordered_text(events: DataFrame) -> DataFrame:
    """What a reader of the events of each request sees: its deltas in order, or a refusal."""
    parts = F.array_sort(F.collect_list(F.when(F.col("event") == "delta", F.struct("seq", "data"))))
    return events.groupBy("request_id").agg(F.array_join(F.transform(parts, lambda p: p["data"]), "").alias("answer"), F.bool_or(F.col("event") == "refused").alias("refused"))
