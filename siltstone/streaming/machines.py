"""State machines over streams: rows of a key in order of time, and timers for what happens when no row comes.

Rows wait until the watermark has passed them, so a machine sees them in order whatever the order in which files and batches
bring them.  What a machine says does not depend on how rows fall into micro-batches: a deadline that passes between two rows
is told between them, one that passes behind the last row is told by a timer.  State is kept in RocksDB, off the heap.

Keys are dealt out by their hashes into buckets, and a bucket is read, run and stored at once: calls to the state store grow
with buckets and batches, not with keys.  A bucket in which something happens is read as a whole, so a stream with very many
keys and small batches wants more buckets; their number stays as it is while a checkpoint is used.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.readwriter import DataStreamWriter

from siltstone.operators.delivery import ATTEMPTS, STALE_SECONDS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECOND = 1_000_000
BUCKETS = 1024
#: Rows or keys in one value of the state store and in one frame of results.
_CHUNK = 10_000
#: The time of rows that have none: before all others.
_NO_TIME = -(2**63)


def start(writer: DataStreamWriter, spark) -> StreamingQuery:  # noqa: ANN001
    """Starts a query whose state needs lists and timers; the session's own state store stays as it was."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        return writer.start()
    finally:
        spark.conf.set(_PROVIDER, before) if before else spark.conf.unset(_PROVIDER)


def _chunks(items: list) -> Iterator[list]:
    return (items[i : i + _CHUNK] for i in range(0, len(items), _CHUNK))


class _InOrder(StatefulProcessor):
    """Rows (at, what, a, b) of a key in order.  ``state`` is a tuple, ``outputs`` are tuples without the key."""

    FIRST, COLUMNS = (), ()

    def step(self, state: tuple, at: int, what: str, a: float, b: float) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def deadline(self, state: tuple) -> int | None:
        """When something happens by itself, in microseconds."""
        return None

    def expire(self, state: tuple, at: int) -> tuple[tuple, list[tuple]]:
        return state, []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.states = handle.getListState("states", "states binary")
        self.wake = handle.getValueState("wake", "at long")

    def close(self) -> None:
        pass

    def _wake(self, at: int) -> None:
        """A bucket has one timer, for what comes first."""
        at, before = -(-at // 1000), self.wake.get()
        if before is None or at < before[0]:
            if before is not None:
                self.handle.deleteTimer(before[0])
            self.handle.registerTimer(at)
            self.wake.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        least = None
        for pdf in rows:
            new = list(zip(*(pdf[c].tolist() for c in ("key", "us", "what", "a", "b")), strict=True))
            if new:
                self.waiting.appendList([(pickle.dumps(part),) for part in _chunks(new)])
                first = min(r[1] for r in new)
                least = first if least is None else min(least, first)
        if least is not None:
            self._wake(least)
        yield from ()

    def _stored(self, held) -> Iterator[tuple]:  # noqa: ANN001
        for (part,) in held.get():
            yield from pickle.loads(part)

    def _store(self, held, items: Iterable[tuple]) -> None:  # noqa: ANN001
        parts = [(pickle.dumps(part),) for part in _chunks(list(items))]
        held.put(parts) if parts else held.clear()

    def _run(self, state: tuple, due: list[tuple], now: int) -> tuple[tuple, list[tuple]]:
        """One key up to ``now``."""
        outputs = []

        def passed(limit: int, included: bool) -> None:
            nonlocal state
            while (at := self.deadline(state)) is not None and (at < limit or (included and at == limit)):
                state, more = self.expire(state, at)
                outputs.extend(more)

        for row in sorted(due):
            passed(row[0], False)
            state, more = self.step(state, *row)
            outputs += more
        passed(now, True)
        return state, outputs

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803, ANN001
        now = timerValues.getCurrentWatermarkInMs() * 1000
        self.wake.clear()
        due, rest, states = defaultdict(list), [], dict(self._stored(self.states))
        for row in self._stored(self.waiting):
            if row[1] <= now:
                due[row[0]].append(row[1:])
            else:
                rest.append(row)
        said, following = [], min((r[1] for r in rest), default=None)
        for k in {**states, **due}:
            before = states.get(k, self.FIRST)
            states[k], outputs = self._run(before, due.get(k, []), now)
            said += [(k, *o) for o in outputs]
            until = self.deadline(states[k])
            if until is not None and (following is None or until < following):
                following = until
        self._store(self.waiting, rest)
        self._store(self.states, states.items())
        if following is not None:
            self._wake(following)
        for part in _chunks(said):
            yield pd.DataFrame(part, columns=["key", *self.COLUMNS])


def _run(rows: DataFrame, machine: _InOrder, schema: str, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """Keys and times pass as texts and whole numbers: pandas would make floats of numbers beside nulls, and local times."""
    kind = rows.schema["key"].dataType
    rows = rows.withWatermark("at", delay).withColumns({"key": F.col("key").cast("string"), "us": F.coalesce(F.unix_micros("at"), F.lit(_NO_TIME)), "bucket": F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")})
    said = rows.groupBy("bucket").transformWithStateInPandas(machine, "key string, " + schema.replace("at timestamp", "at long"), "append", "EventTime")
    return said.withColumns({"key": F.col("key").cast(kind), "at": F.timestamp_micros(F.nullif("at", F.lit(_NO_TIME)))})


class _Delivery(_InOrder):
    """State: status, attempts, when it was claimed, and how many changes there were."""

    FIRST, COLUMNS = ("", 0, 0, 0), ("change", "at", "status", "retry_count")

    def _to(self, state: tuple, at: int, status: str, tries: int, since: int) -> tuple[tuple, list[tuple]]:
        return (status, tries, since, state[3] + 1), [(state[3], at, status, tries)]

    def step(self, state: tuple, at: int, what: str, a: float, b: float) -> tuple[tuple, list[tuple]]:
        outputs = []
        if not state[0]:
            state, outputs = self._to(state, at, "pending", 0, 0)
        status, tries, since, _ = state
        if what == "claim" and status in ("pending", "failed", "stale") and tries < ATTEMPTS:
            state, more = self._to(state, at, "sending", tries + (status != "pending"), at)
            outputs += more
        elif what != "claim" and status in ("sending", "stale"):
            state, more = self._to(state, at, what, tries, since)
            outputs += more
        return state, outputs

    def deadline(self, state: tuple) -> int | None:
        return state[2] + STALE_SECONDS * SECOND if state[0] == "sending" else None

    def expire(self, state: tuple, at: int) -> tuple[tuple, list[tuple]]:
        return self._to(state, at, "stale", state[1], state[2])


def delivery_states(actions: DataFrame, *, delay: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """Every change of every notification, from a stream of actions (key, at, action in claim, sent, failed): key, change (a
    number from 0), at, status, retry_count.

    PENDING -> SENDING -> SENT or FAILED.  What is sending for over five minutes turns stale by a timer, without another row.
    A claim of a failed or stale notification costs an attempt, the first claim does not; after three attempts nothing more
    is claimed.  A result that comes late still counts.  Of rows of one time the action decides.  Rows behind the watermark,
    ``delay`` behind the latest row, are dropped.
    """
    rows = actions.select(F.col("key").cast("long").alias("key"), "at", F.col("action").alias("what"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    return _run(rows, _Delivery(), "change long, at timestamp, status string, retry_count long", delay, buckets)


class _Cadence(_InOrder):
    """State: the last grant, when a retry is due, and its attempt."""

    FIRST, COLUMNS = (None, None, 0), ("at", "attempt")

    def step(self, state: tuple, at: int, what: str, a: float, b: float) -> tuple[tuple, list[tuple]]:
        granted, retry_at, attempt = state
        if what == "retry":
            return (granted, at + int(b * SECOND), attempt + 1), []
        if retry_at is not None:
            return ((at, None, attempt), [(at, attempt)]) if at >= retry_at else (state, [])
        if granted is None or at >= granted + int(a * SECOND):
            return (at, None, 0), [(at, 0)]
        return state, []


def cadence_grants(ticks: DataFrame, *, delay: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """Which polls of a provider may run, over a stream of (key, at, cadence, action, delay): key, at, attempt.

    A tick is granted when the cadence since the last grant is over, or when a retry that was asked for is due; a retry (with
    its delay in seconds) opens the gate again and carries the attempt on, a tick by cadence starts at attempt 0.
    """
    rows = ticks.select("key", "at", F.col("action").alias("what"), F.col("cadence").cast("double").alias("a"), F.col("delay").cast("double").alias("b"))
    return _run(rows, _Cadence(), "at timestamp, attempt long", delay, buckets)


class _Deadlines(_InOrder):
    """State: when the run began, its deadline, and what it ended with."""

    FIRST, COLUMNS = (None, None, None), ("at", "outcome")

    def step(self, state: tuple, at: int, what: str, a: float, b: float) -> tuple[tuple, list[tuple]]:
        began, until, outcome = state
        if outcome is not None:
            return state, []
        if what == "started":
            return ((at, at + int(a * SECOND), None), []) if began is None else (state, [])
        return (began, until, what), [(at, "COLLECTION_CANCELLED" if what == "cancelled" else what)]

    def deadline(self, state: tuple) -> int | None:
        return state[1] if state[1] is not None and state[2] is None else None

    def expire(self, state: tuple, at: int) -> tuple[tuple, list[tuple]]:
        return (state[0], state[1], "timeout"), [(at, "COLLECTION_TIMEOUT")]


def run_outcomes(events: DataFrame, *, delay: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """What each run ended with, from a stream of (key, at, event, deadline): key, at, outcome.

    ``event`` is started, cancelled, or how a run says it ended (succeeded, or an error code); ``deadline`` are the seconds
    that a started run has.  The first end counts: a run that says nothing by its deadline is COLLECTION_TIMEOUT then, by a
    timer; what it says later is passed over, as is a second start.
    """
    rows = events.select(F.col("key").cast("string").alias("key"), "at", F.col("event").alias("what"), F.coalesce(F.col("deadline").cast("double"), F.lit(0.0)).alias("a"), F.lit(0.0).alias("b"))
    return _run(rows, _Deadlines(), "at timestamp, outcome string", delay, buckets)
