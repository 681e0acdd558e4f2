"""Keyed state: answers restored as they stream, and ordered rules over late events.

Each operator is a ``StatefulProcessor`` for ``transformWithStateInPandas`` (RocksDB
state); what it decides for a key depends on that key's rows only.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lakewarden.functions.spans import PLACEHOLDER, Pattern, match_spans, splice
from lakewarden.operators.ordered import BoundedQueue, Machine, OneDecision, SlidingLimit

#: Fixed value: a longer unfinished placeholder is sent as plain text.
LONGEST = 48
_WHOLE = re.compile(PLACEHOLDER)
#: A tail that more text could turn into a placeholder.
_OPEN = re.compile(r"<(?:[A-Z][A-Z_]*[0-9]*)?\Z")


def open_tail(text: str) -> int:
    """Where the tail starts that must wait for more text; the text's length if none does."""
    found = _OPEN.search(text)
    return found.start() if found and len(text) - found.start() < LONGEST else len(text)


class AnswerRestorer(StatefulProcessor):
    """Rows ``chunk_no, content, last, vault_json`` by (request, choice): the restored text sent for each chunk.

    ``vault_json`` maps placeholders that the reader may see to values. What waits is sent with
    the chunk that is ``last``, or by itself, one chunk later, once the upstream has been
    silent for ``idle_seconds``.
    """

    def __init__(self, idle_seconds: int = 60):
        self.idle = idle_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "text string, chunk_no long, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        pending = self.waiting.get()[0] if self.waiting.exists() else ""
        sent = []
        for row in pd.concat(list(rows)).sort_values("chunk_no").itertuples(index=False):
            text = pending + (row.content or "")
            cut = len(text) if row.last else open_tail(text)
            known = json.loads(row.vault_json or "{}")
            sent.append((key[0], key[1], row.chunk_no, _WHOLE.sub(lambda m, v=known: v.get(m[0], m[0]), text[:cut])))
            pending = text[cut:]
        if pending:
            until = timerValues.getCurrentProcessingTimeInMs() + self.idle
            self.waiting.update((pending, int(sent[-1][2]), until))
            self.handle.registerTimer(until)
        else:
            self.waiting.clear()
        yield pd.DataFrame(sent, columns=["request_id", "choice", "chunk_no", "content"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        sent = []
        if self.waiting.exists():
            text, chunk_no, until = self.waiting.get()
            if expiredTimerInfo.getExpiryTimeInMs() >= until:
                sent.append((key[0], key[1], chunk_no + 1, text))
                self.waiting.clear()
        yield pd.DataFrame(sent, columns=["request_id", "choice", "chunk_no", "content"])

    def close(self) -> None:
        pass


def demask_stream(chunks: DataFrame, idle_seconds: int = 60) -> DataFrame:
    return chunks.groupBy("request_id", "choice").transformWithStateInPandas(
        AnswerRestorer(idle_seconds), "request_id string, choice int, chunk_no long, content string", "Append", "ProcessingTime"
    )


def with_last(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """``chunks`` with ``last``: a choice ends at its finish reason, or at its last chunk when the answer is done.

    done: ``request_id`` of answers whose upstream has ended, by a closing line or by itself.
    """
    ended = chunks.join(done.select("request_id").distinct().withColumn("__done", F.lit(True)), "request_id", "left")
    final = ended.groupBy("request_id", "choice").agg(F.max("chunk_no").alias("__most"))
    ended = ended.join(final, ["request_id", "choice"])
    last = F.col("finish_reason").isNotNull() | (F.coalesce("__done", F.lit(False)) & (F.col("chunk_no") == F.col("__most")))
    return ended.withColumn("last", last).drop("__done", "__most")


class InOrder(StatefulProcessor):
    """Runs a machine over a key's rows in event-time order, each row once the watermark has passed it.

    Rows ``n, micros`` and the machine's columns. A row waits as long as an earlier one may
    still come, so arrival order does not matter; one later than the watermark is dropped before
    it gets here, as everywhere in Structured Streaming, and has no effect. A state that
    can have no more effect leaves.
    """

    def __init__(self, machine: Machine):
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "json string")
        self.waiting = handle.getListState("waiting", "micros long, n long, row string")

    def _none(self) -> pd.DataFrame:
        return pd.DataFrame([], columns=["key", "n", *[f.name for f in self.machine.returns]])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        timers = set()
        for frame in rows:
            for row in frame.itertuples(index=False):
                fields = [_plain(getattr(row, c)) for c in self.machine.reads]
                self.waiting.appendValue((int(row.micros), int(row.n), json.dumps(fields)))
                timers.add(-(-int(row.micros) // 1000))
        for at in timers:
            self.handle.registerTimer(at)
        yield self._none()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1) * 1000
        held = [(int(t), int(n), row) for t, n, row in self.waiting.get()] if self.waiting.exists() else []
        ready, rest = sorted(h for h in held if h[0] <= now), [h for h in held if h[0] > now]
        state = json.loads(self.state.get()[0]) if self.state.exists() else self.machine.start()
        out = []
        for micros, n, row in ready:
            state, found = self.machine.step(state, micros, tuple(json.loads(row)))
            out.append(("|".join("" if k is None else str(k) for k in key), n, *found))
        until = self.machine.forget_at(state)
        if until is not None and until <= now and not rest:
            self.state.clear()
        else:
            self.state.update((json.dumps(state),))
            if ready and until:
                self.handle.registerTimer(-(-until // 1000))
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        yield pd.DataFrame(out, columns=self._none().columns) if out else self._none()

    def close(self) -> None:
        pass


def _plain(value):
    """A value as JSON can hold it."""
    if value is None or (isinstance(value, float) and value != value):
        return None
    return value.item() if hasattr(value, "item") else value


def in_order(events: DataFrame, keys: list[str], machine: Machine, at: str = "at", lateness: str = "10 minutes") -> DataFrame:
    """``key, n`` and what the machine returns, for a stream of ``keys, n``, the event time ``at`` and the machine's columns.

    ``key`` joins the key's values by ``|``. Rows up to ``lateness`` late are decided in their right place.
    """
    rows = events.withColumn("micros", F.unix_micros(at)).withWatermark(at, lateness)
    rows = rows.select(*keys, at, "n", "micros", *machine.reads)
    schema = ", ".join(["key string", "n long", *[f"{f.name} {f.dataType.simpleString()}" for f in machine.returns]])
    return rows.groupBy(*keys).transformWithStateInPandas(InOrder(machine), schema, "Append", "EventTime")


def rate_limit_stream(calls: DataFrame, limit: int, window_seconds: int, lateness: str = "10 minutes") -> DataFrame:
    """Calls ``tool, subject, n, at``: admitted or not."""
    return in_order(calls, ["tool", "subject"], SlidingLimit(limit, window_seconds), lateness=lateness)


def confirmation_stream(events: DataFrame, lifetime_seconds: int = 900, lateness: str = "10 minutes") -> DataFrame:
    """Actions ``confirmation_id, n, at, action, allowed, args_ok, succeeds``: code and status of each."""
    return in_order(events, ["confirmation_id"], OneDecision(lifetime_seconds), lateness=lateness)


def queue_stream(events: DataFrame, limit: int, sinks: tuple[str, ...], lateness: str = "10 minutes") -> DataFrame:
    """Puts and acks ``queue, n, at, kind, item, sink``: depth after each, and whether it was refused."""
    return in_order(events, ["queue"], BoundedQueue(limit, sinks), lateness=lateness)


class ContextStore(StatefulProcessor):
    """Rows ``n, kind (put or get), value`` by request: what a get finds; entries leave after their time to live."""

    def __init__(self, ttl_seconds: int = 600):
        self.ttl = ttl_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("value", "value string", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        for row in pd.concat(list(rows)).sort_values("n").itertuples(index=False):
            if row.kind == "put":
                self.value.update((row.value,))
            found = self.value.get()[0] if self.value.exists() else None
            out.append((key[0], row.n, found))
        yield pd.DataFrame(out, columns=["request_id", "n", "value"])

    def close(self) -> None:
        pass


def context_stream(events: DataFrame, ttl_seconds: int = 600) -> DataFrame:
    return events.groupBy("request_id").transformWithStateInPandas(
        ContextStore(ttl_seconds), "request_id string, n long, value string", "Append", "ProcessingTime"
    )


def checkpoints_due(counts: DataFrame, every: int, seconds: int, at: str = "at") -> DataFrame:
    """``seg, due_at, entries``: a checkpoint for every ``every`` entries of a segment, or for what came in ``seconds``.

    Entries ``seg, at`` fall into windows of ``seconds``; in a window one checkpoint is due for
    each full ``every`` entries, and one at its end for the rest.
    """
    windows = counts.groupBy("seg", F.window(at, f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("entries"))
    return windows.select("seg", F.col("w.end").alias("due_at"), "entries", F.ceil(F.col("entries") / every).cast("long").alias("checkpoints"))


def demask_chunks(chunks: DataFrame, vault: Column, keys: tuple[str, ...] = ("request_id", "choice")) -> DataFrame:
    """Batch form: a whole answer put together in chunk order, then restored in one pass.

    ``vault`` is ``map<placeholder, value>`` of what the reader may see.
    """
    whole = chunks.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", F.coalesce("content", F.lit("")).alias("c")))), lambda x: x["c"]), "").alias("text"),
        F.first(vault).alias("__vault"),
    )
    spans = match_spans(F.col("text"), Pattern(PLACEHOLDER))
    back = lambda x: F.coalesce(F.try_element_at(F.col("__vault"), x["v"]), x["v"])
    return whole.select(*keys, splice(F.col("text"), spans, back).alias("text"))
