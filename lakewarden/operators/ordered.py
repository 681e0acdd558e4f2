"""Path-dependent rules as small state machines, run over sorted rows with constant memory.

A machine decides row by row and keeps a small state for a key; what it decides for a row
depends on the decisions before it, so no window frame expresses it. ``folded`` runs one
over a table: rows are dealt by key, sorted, and streamed past the machine, so no key's rows
are ever gathered. ``lakewarden.streaming.stateful`` runs the same machines over streams.
"""

from __future__ import annotations

from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BooleanType, IntegerType, StringType, StructField, StructType

SECOND = 1_000_000


class Machine(Protocol):
    #: Columns a step reads beside the key and the time in microseconds, and columns it returns.
    reads: tuple[str, ...]
    returns: tuple[StructField, ...]

    def start(self) -> Any: ...

    def step(self, state: Any, micros: int, row: tuple) -> tuple[Any, tuple]: ...

    def forget_at(self, state: Any) -> int | None:
        """When a state has no further effect, in microseconds; None: never."""


class SlidingLimit:
    """Admits a call if fewer than ``limit`` were admitted in the ``seconds`` before it; refused calls do not count."""

    reads: tuple[str, ...] = ()
    returns = (StructField("admitted", BooleanType()),)

    def __init__(self, limit: int, seconds: int):
        self.limit, self.span = limit, seconds * SECOND

    def start(self) -> list[int]:
        return []

    def step(self, state: list[int], micros: int, row: tuple) -> tuple[list[int], tuple]:
        held = [t for t in state if t > micros - self.span]
        admitted = len(held) < self.limit
        return ([*held, micros] if admitted else held), (admitted,)

    def forget_at(self, state: list[int]) -> int | None:
        return max(state, default=0) + self.span


class OneDecision:
    """A confirmation: pending, then one of rejected, denied, executed, failed or expired; codes as HTTP has them.

    An action after the lifetime finds it expired (409); reject and approve act once; approve
    re-checks permission (403) and arguments (400). It is forgotten ``keep`` seconds after expiry.
    """

    reads = ("action", "allowed", "args_ok", "succeeds")
    returns = (StructField("code", IntegerType()), StructField("status", StringType()))

    def __init__(self, lifetime_seconds: int = 900, keep_seconds: int = 3600):
        self.life, self.keep = lifetime_seconds * SECOND, keep_seconds * SECOND

    def start(self) -> list:
        return ["none", 0]

    def step(self, state: list, micros: int, row: tuple) -> tuple[list, tuple]:
        status, created = state
        action, allowed, args_ok, succeeds = row
        if status == "none":
            if action == "create":
                return ["pending", micros], (202, "pending")
            return state, (404, status)
        if status != "pending":
            return state, (409, status)
        if micros > created + self.life:
            code, status = 409, "expired"
        elif action == "reject":
            code, status = 200, "rejected"
        elif action != "approve":
            code = 409
        elif not allowed:
            code, status = 403, "denied"
        elif not args_ok:
            code, status = 400, "denied"
        else:
            code, status = 200, "executed" if succeeds else "failed"
        return [status, created], (code, status)

    def forget_at(self, state: list) -> int | None:
        return state[1] + self.life + self.keep


class BoundedQueue:
    """A durable queue: a put is refused when ``limit`` items wait, and an item leaves once every sink has acknowledged it.

    Rows are puts and acks (``kind``) of an ``item`` by a ``sink``; a repeated ack changes nothing.
    """

    reads = ("kind", "item", "sink")
    returns = (StructField("depth", IntegerType()), StructField("refused", BooleanType()))

    def __init__(self, limit: int, sinks: tuple[str, ...]):
        self.limit, self.sinks = limit, tuple(sinks)

    def start(self) -> dict:
        return {}

    def step(self, state: dict, micros: int, row: tuple) -> tuple[dict, tuple]:
        kind, item, sink = row
        item, state, refused = str(item), dict(state), False
        if kind == "put":
            refused = item not in state and len(state) >= self.limit
            if not refused:
                state.setdefault(item, list(self.sinks))
        elif item in state:
            state[item] = [s for s in state[item] if s != sink]
            if not state[item]:
                del state[item]
        return state, (len(state), refused)

    def forget_at(self, state: dict) -> int | None:
        return None if state else 0


def folded(rows: DataFrame, keys: list[str], micros: str, order: list[str], machine: Machine) -> DataFrame:
    """``keys, micros, order`` and what the machine returns for every row, by time and ``order`` within a key.

    A null time comes first and counts as 0. Null keys are a key of their own.
    """
    shown = list(dict.fromkeys([*keys, micros, *order]))
    own = rows.select(*shown, *[F.col(c).alias(f"__{c}") for c in machine.reads])
    own = own.repartition(*keys).sortWithinPartitions(*keys, micros, *order)
    schema = StructType([*[rows.schema[c] for c in shown], *machine.returns])
    kinds = [to_arrow_type(f.dataType) for f in machine.returns]
    width, at = len(keys), shown.index(micros)

    def run(batches):
        key, state = object(), None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            found = []
            for row in zip(*columns, strict=True):
                if row[:width] != key:
                    key, state = row[:width], machine.start()
                state, result = machine.step(state, row[at] or 0, row[len(shown) :])
                found.append(result)
            made = [pa.array([r[i] for r in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(shown)], *made], names=schema.names)

    return own.mapInArrow(run, schema)
