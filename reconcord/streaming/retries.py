"""Deliveries tried again by timers until they succeed or their attempts are used up.

State has one key for each of ``buckets`` shares of the deliveries, dealt by the
hash of their ids: the pending ones with their bodies, attempts and instants, and
the ends that are remembered.  A bucket is read and written as a whole, once a
micro-batch that touches it, so a round trip to the store serves many
deliveries; a task holds one bucket.  An attempt that fails sets the instant of
the next one, and a bucket has a timer for its earliest; nothing polls.
State and timers are in the checkpoint, so a query that is stopped, or an
executor that is lost, goes on where it was.  A micro-batch that is replayed
repeats its attempts, so an attempt must be safe to repeat, and its rows, each
with its error, have the key (delivery_id, attempt) for ``idempotent_append``.

The clock is that of processing, or the watermark of ``at`` (event time), under
which a run over recorded deliveries is the same whenever it is made.  Where the
watermark passes several instants of a delivery at once, its attempts follow in
one go, each at its own instant.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

MAX_ATTEMPTS = 8
#: Milliseconds for which the end of a delivery is remembered, so that a repeat changes nothing.
KEEP = 7 * 24 * 3600 * 1000
#: First delay and longest delay in milliseconds, and the spread of both by the delivery's id.
FIRST, LONGEST, LEAST, SPREAD = 1000, 300_000, 0.875, 0.25
#: Characters of an error that are kept.
ERROR = 2000
#: Keys of state; fixed for a checkpoint, as ids are dealt by it.
BUCKETS = 4096
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "delivery_id string, attempt int, state string, at timestamp, next_at timestamp, error string"


def delay(attempts: int, delivery_id: str) -> int:
    """Milliseconds until the next attempt, after so many: doubling up to a limit, spread by the last two hexadecimal digits of the id."""
    base = min(FIRST * 2 ** max(0, attempts - 1), LONGEST)
    try:
        share = int(delivery_id[-2:], 16)
    except ValueError:
        share = 128
    return int(base * (LEAST + share / 255 * SPREAD) + 0.5)


class Retries(StatefulProcessor):
    """``attempt`` takes (delivery_id, body, number of the attempt) and returns an error's text, or null if it succeeded."""

    def __init__(self, attempt: Callable[[str, str | None, int], str | None], most: int, event_time: bool, wait: Callable[[int, str], int], keep: int):
        self.attempt, self.most, self.event_time, self.wait, self.keep = attempt, most, event_time, wait, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "delivery_id string, body string, attempts int, due long")
        self.ended = handle.getListState("ended", "delivery_id string, until long")

    def _clock(self, timers) -> int:
        return timers.getCurrentWatermarkInMs() if self.event_time else timers.getCurrentProcessingTimeInMs()

    def _try(self, waits: dict, ends: list, key: str, body: str | None, attempts: int, at: int, now: int) -> Iterator[Row]:
        """The attempt of ``at`` and those that are due by ``now``; then the delivery is in ``waits`` or in ``ends``."""
        while True:
            attempts += 1
            try:
                error = self.attempt(key, body, attempts)
            except Exception as raised:  # a delivery that raises fails its attempt, not the stream
                error = f"{type(raised).__name__}: {raised}"
            error = None if error is None else error[:ERROR]
            state = "processed" if error is None else "failed" if attempts >= self.most else "pending"
            due = at + self.wait(attempts, key) if state == "pending" else None
            yield Row(delivery_id=key, attempt=attempts, state=state, at=_instant(at), next_at=None if due is None else _instant(due), error=error)
            if due is None:
                ends.append((key, at + self.keep))
                return
            if not self.event_time or due > now:
                waits[key] = (body, attempts, due)
                return
            at = due

    def _kept(self, waits: dict, old: list, ends: list, now: int) -> None:
        """Writes what waits and what has ended, and sets the bucket's timer."""
        if waits:
            self.pending.put([(key, *rest) for key, rest in waits.items()])
        else:
            self.pending.clear()
        known = [e for e in old if e[1] > now]
        # forgotten ends are taken out when they are half of all, so that each is written a few times
        if len(known) <= len(old) // 2 and old:
            if known + ends:
                self.ended.put(known + ends)
            else:
                self.ended.clear()
        elif ends:
            known = old
            self.ended.appendList(ends)
        due = min((rest[2] for rest in waits.values()), default=None)
        if due is None and (known or ends):
            due = max(until for _, until in known + ends)
        if due is not None and not any(t <= due for t in self.handle.listTimers() if t > now):
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = self._clock(timerValues)
        first: dict[str, tuple] = {}
        for row in rows:  # repeats of one id bear one body; the earliest begins it
            seen = first.get(row["delivery_id"])
            if seen is None or (row["at_ms"] or 0) < seen[1]:
                first[row["delivery_id"]] = (row["body"], row["at_ms"] or 0)
        waits, old, ends = self._waits(), list(self.ended.get()), []
        known = {e[0] for e in old if e[1] > now}
        for own, (body, at) in first.items():
            if own not in waits and own not in known:
                yield from self._try(waits, ends, own, body, 0, at if self.event_time else now, now)
        self._kept(waits, old, ends, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = self._clock(timerValues)
        waits, ends = self._waits(), []
        for own, (body, attempts, due) in [w for w in waits.items() if w[1][2] <= now]:
            del waits[own]
            yield from self._try(waits, ends, own, body, attempts, due if self.event_time else now, now)
        self._kept(waits, list(self.ended.get()), ends, now)

    def _waits(self) -> dict[str, tuple]:
        return {key: (body, attempts, due) for key, body, attempts, due in self.pending.get()}

    def close(self) -> None:
        pass


def _instant(ms: int):
    from datetime import UTC, datetime, timedelta

    return datetime(1970, 1, 1, tzinfo=UTC) + timedelta(milliseconds=ms)


def retries(
    deliveries: DataFrame, attempt: Callable[[str, str | None, int], str | None], at: str = "received_at", event_time: bool = False, delay_of: str = "0 seconds",
    most: int = MAX_ATTEMPTS, wait: Callable[[int, str], int] = delay, keep: int = KEEP, buckets: int = BUCKETS,
) -> DataFrame:
    """A row for each attempt (delivery_id, attempt, state, at, next_at, error) of a stream of deliveries (delivery_id, body, ``at``).

    state: pending (another attempt follows at next_at), processed, or failed
    after ``most`` attempts.  A delivery without id is none; a null body is
    handed on as it is.  A repeat of a delivery that is pending, or ended within
    ``keep`` milliseconds, changes nothing.
    """
    spark = deliveries.sparkSession
    if not spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"retries by timers need spark.sql.streaming.stateStore.providerClass={PROVIDER}")
    own = deliveries.where("delivery_id is not null")
    if event_time:
        own = own.withWatermark(at, delay_of)
    own = own.select("delivery_id", F.col("body").cast("string").alias("body"), F.unix_millis(F.col(at)).alias("at_ms"), *([F.col(at)] if event_time else []))
    processor = Retries(attempt, most, event_time, wait, keep)
    own = own.withColumn("bucket", F.pmod(F.xxhash64("delivery_id"), F.lit(buckets)).cast("int"))
    return own.groupBy("bucket").transformWithState(processor, OUTPUT, "Append", "EventTime" if event_time else "ProcessingTime")
