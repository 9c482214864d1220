"""Operators with state by key on transformWithState: event-time timers let go of what can't matter any more.

All take streams with a watermark on an event-time column; rows that come later than it allows are dropped by Spark. A
batch's rows of a key are sorted before they count. State lies in RocksDB, which rocksdb() asks for while a query starts.

throttled   hits within a sliding window          list of hit times     goes when the last one has left the window
broken      circuit breaker after a refusal       time until it's open  goes when that time has passed
framed      frames of chunks that come in any     next chunk, rest,     goes with the last chunk, or after silence, with a row
            order, across batches                 chunks that wait      that tells so
every_nth   a trigger by count                    messages so far       goes after silence
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """A query that is started within keeps its state in RocksDB, in no more than four partitions for each core, as each takes
    about a third of a second a batch, with or without rows; the session's own settings are back afterwards."""
    old = {k: spark.conf.get(k) for k in (PROVIDER, PARTITIONS)}
    spark.conf.set(PROVIDER, ROCKSDB)
    spark.conf.set(PARTITIONS, str(min(int(old[PARTITIONS]), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


class Silent(StatefulProcessor):
    """A processor whose key goes when the watermark passes a time that each batch may move on.

    Each call to the state is a message to the JVM and back, so a key keeps its timer (for when it is set, and when it is to
    go) in a value that it reads and writes anyway. A time that moves on leaves the timer; one that comes up early is set anew.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def moved(self, timer: int | None, until: int) -> int:
        """The key's only timer, which comes up at until or before."""
        if timer is not None:
            if timer <= until:
                return timer
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(until)
        return until

    def close(self) -> None:
        pass


class Throttle(Silent):
    def __init__(self, window_ms: int, most: int) -> None:
        self.window, self.most = window_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.hits = handle.getListState("hits", "at long")
        self.timer = handle.getValueState("timer", "timer long, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = sorted((r.at, r.event_id) for r in rows)
        old = sorted(r[0] for r in self.hits.get())
        past = timerValues.getCurrentWatermarkInMs() - self.window
        kept = old[bisect_right(old, past) :]  # no row that may still come has these in its window
        times = sorted(kept + [at for at, _ in new])
        done = 0
        for i, (at, event) in enumerate(new):
            done = done + 1 if i and at == new[i - 1][0] else 1  # hits of one time count in order
            same = bisect_right(times, at) - bisect_right(times, at - 1)
            n = bisect_right(times, at) - bisect_right(times, at - self.window) - same + bisect_right(kept, at) - bisect_right(kept, at - 1) + done
            yield Row(event_id=event, n_recent=n, limited=n > self.most)
        if len(kept) == len(old):
            self.hits.appendList([(at,) for at, _ in new])
        else:
            self.hits.put([(at,) for at in times])
        timer, _ = self.timer.get() or (None, None)
        until = times[-1] + self.window
        self.timer.update((self.moved(timer, until), until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        _, until = self.timer.get()
        if until > timerValues.getCurrentWatermarkInMs():
            self.timer.update((self.moved(None, until), until))
        else:
            self.hits.clear()
            self.timer.clear()
        return iter(())


class Breaker(Silent):
    def __init__(self, cooldown_ms: int) -> None:
        self.cooldown = cooldown_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.until = handle.getValueState("open", "until long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before, timer = self.until.get() or (0, None)
        until = before
        for at, event, refused in sorted((r.at, r.event_id, bool(r.refused)) for r in rows):
            yield Row(event_id=event, skipped=at < until)
            if at >= until and refused:
                until = at + self.cooldown
        if until != before:
            self.until.update((until, self.moved(timer, until)))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until, _ = self.until.get()
        if until > timerValues.getCurrentWatermarkInMs():
            self.until.update((until, self.moved(None, until)))
        else:
            self.until.clear()
        return iter(())


class Frames(Silent):
    def __init__(self, silence_ms: int) -> None:
        self.silence = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.place = handle.getValueState("place", "next long, frames long, rest string, held long, timer long, until long")
        self.waiting = handle.getListState("waiting", "n long, chunk string, last boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = list(rows)
        known = self.place.get()
        next_, frames, rest, waits, timer, _ = known or (0, 0, "", 0, None, None)
        held = {r.n: (r.chunk or "", bool(r.last)) for r in rows if r.n >= next_}
        held |= {n: (chunk, last) for n, chunk, last in self.waiting.get()} if waits else {}
        ended = False
        parts = [rest]
        while not ended and next_ in held:
            chunk, ended = held.pop(next_)
            parts.append(chunk)
            next_ += 1
        *whole, rest = "".join(parts).replace("\r\n", "\n").split("\n\n") if len(parts) > 1 else (rest,)
        if ended and rest:
            whole.append(rest)
        for frame in whole:
            yield Row(stream=key[0], place=frames, frame=frame, broken=False)
            frames += 1
        if ended:
            if known:
                self.forget(waits)
                self.handle.deleteTimer(timer)
            return
        # a line end that is cut in two stays whole in the rest
        until = max(r.at for r in rows) + self.silence
        self.place.update((next_, frames, rest, len(held), self.moved(timer, until), until))
        if held:
            self.waiting.put([(n, *x) for n, x in held.items()])
        elif waits:
            self.waiting.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        next_, frames, rest, waits, _, until = self.place.get()
        if until > timerValues.getCurrentWatermarkInMs():
            self.place.update((next_, frames, rest, waits, self.moved(None, until), until))
            return
        self.forget(waits)
        yield Row(stream=key[0], place=frames, frame=None, broken=True)

    def forget(self, waits: int) -> None:
        self.place.clear()
        if waits:
            self.waiting.clear()


class Counter(Silent):
    def __init__(self, every: int, silence_ms: int) -> None:
        self.every, self.silence = every, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.count = handle.getValueState("count", "n long, timer long, until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, timer, _ = self.count.get() or (0, None, None)
        last = 0
        for place, at in sorted((r.place, r.at) for r in rows):
            n, last = n + 1, max(last, at)
            if n % self.every == 0:
                yield Row(key=key[0], fired=n // self.every, upto=place)
        until = last + self.silence
        self.count.update((n, self.moved(timer, until), until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, _, until = self.count.get()
        if until > timerValues.getCurrentWatermarkInMs():
            self.count.update((n, self.moved(None, until), until))
        else:
            self.count.clear()
        return iter(())


def timed(rows: DataFrame, delay: str) -> DataFrame:
    """rows with a watermark on their time `at` in milliseconds."""
    return rows.withColumn("time", F.timestamp_millis("at")).withWatermark("time", delay)


def throttled(hits: DataFrame, window_ms: int, most: int, delay: str = "1 hour") -> DataFrame:
    """(event_id, n_recent, limited) for a stream of (event_id, user_id, at): hits in (at - window_ms, at] that have come."""
    return timed(hits, delay).groupBy("user_id").transformWithState(Throttle(window_ms, most), "event_id long, n_recent long, limited boolean", "Append", "EventTime")


def broken(hits: DataFrame, cooldown_ms: int, delay: str = "1 hour") -> DataFrame:
    """(event_id, skipped) for a stream of (event_id, user_id, at, refused)."""
    return timed(hits, delay).groupBy("user_id").transformWithState(Breaker(cooldown_ms), "event_id long, skipped boolean", "Append", "EventTime")


def framed(chunks: DataFrame, silence_ms: int = 3_600_000, delay: str = "1 hour") -> DataFrame:
    """(stream, place, frame, broken) for a stream of (stream, n, chunk, last, at): frames between blank lines, numbered.

    Chunks are numbered from 0 on; one that comes early waits for those before it, one that comes twice counts once. What
    is left when the last chunk has come is a frame, too. A stream that is silent for silence_ms gives a row that is broken.
    """
    return timed(chunks, delay).groupBy("stream").transformWithState(Frames(silence_ms), "stream long, place long, frame string, broken boolean", "Append", "EventTime")


def every_nth(rows: DataFrame, key: str, place: str, every: int = 4, silence_ms: int = 86_400_000, delay: str = "1 hour") -> DataFrame:
    """(key, fired, upto) for a stream of rows with their time `at`: a row for each `every` messages of a key, with the place of
    the last of them; what is left over counts for the next."""
    named = timed(rows.select(F.col(key).cast("long").alias("key"), F.col(place).cast("long").alias("place"), "at"), delay)
    return named.groupBy("key").transformWithState(Counter(every, silence_ms), "key long, fired long, upto long", "Append", "EventTime")
