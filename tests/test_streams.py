"""State that expires, views and logs that are kept up, and folds and lookups that gather nothing."""

import json
import threading
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from lectern.operators import folds, joins
from lectern.sources import log
from lectern.streaming import runs, state, views

T0 = 1_704_067_200_000
KIND = "id string, n long"


def arriving(spark, parts, schema, build, tmp_path):
    """What a stream gives whose parts arrive one run after the other."""
    rows = spark.createDataFrame([(i, *r) for i, part in enumerate(parts) for r in part], f"step int, {schema}")
    return runs.in_steps(rows, F.col("step"), len(parts), lambda s: runs.appended(build(s.drop("step")), str(tmp_path / "run")), "test")


# --- state with event-time timers -----------------------------------------------------------

def test_silent_streams_expire(spark, tmp_path):
    """Stream 1 never ends: once the watermark has passed its silence it gives a row that is broken, and starts anew; the first
    chunk of stream 2 comes when the second has been given up."""
    parts = [[(1, 0, "a\n\nb", False, T0), (2, 1, "y\n\n", True, T0 + 5)], [(3, 0, "z", True, T0 + 100_000)], [(2, 0, "x", False, T0 + 100_001), (1, 0, "c\n\n", False, T0 + 200_000)]]
    got = arriving(spark, parts, "stream long, n long, chunk string, last boolean, at long", lambda s: state.framed(s, silence_ms=10_000, delay="1 second"), tmp_path).collect()
    rows = sorted((r.stream, r.place, r.frame or "", r.broken) for r in got)
    assert rows == [(1, 0, "a", False), (1, 0, "c", False), (1, 1, "", True), (2, 0, "", True), (2, 0, "", True), (3, 0, "z", False)]


def test_chunks_out_of_order_and_twice(spark, tmp_path):
    parts = [[(1, 2, "\nd\r\n\r", False, T0)], [(1, 0, "a\n", False, T0 + 1), (1, 2, "\nd\r\n\r", False, T0 + 1)], [(1, 1, "\nb\n", False, T0 + 2), (1, 0, "a\n", False, T0 + 2), (1, 3, "\nlast", True, T0 + 3)]]
    got = arriving(spark, parts, "stream long, n long, chunk string, last boolean, at long", state.framed, tmp_path).orderBy("place").collect()
    assert [(r.place, r.frame) for r in got] == [(0, "a"), (1, "b"), (2, "d"), (3, "last")]


def test_a_silence_that_moves_on(spark, tmp_path):
    """The timer of the first chunk comes up while later ones have moved the silence on."""
    parts = [[(1, 0, "a\n\nb", False, T0)], [(1, 1, "c", False, T0 + 8_000)], [(2, 0, "z", True, T0 + 15_000)], [(1, 2, "d\n\n", False, T0 + 15_500)], [(3, 0, "z", True, T0 + 100_000)]]
    got = arriving(spark, parts, "stream long, n long, chunk string, last boolean, at long", lambda s: state.framed(s, silence_ms=10_000, delay="1 second"), tmp_path).collect()
    assert sorted((r.stream, r.place, r.frame or "", r.broken) for r in got) == [(1, 0, "a", False), (1, 1, "bcd", False), (1, 2, "", True), (2, 0, "z", False), (3, 0, "z", False)]


class Calls:
    """A processor's handle and its states for one key, which counts calls."""

    def __init__(self):
        self.n, self.timers = 0, set()

    def getValueState(self, name, schema):
        return Value(self, None)

    def getListState(self, name, schema):
        return Value(self, [])

    def registerTimer(self, at):
        self.n += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.n += 1
        self.timers.remove(at)


class Value:
    def __init__(self, calls, none):
        self.calls, self.none, self.now = calls, none, none

    def get(self):
        self.calls.n += 1
        return self.now

    def exists(self):
        self.calls.n += 1
        return self.now != self.none

    def update(self, value):
        self.calls.n += 1
        self.now = value

    put = update

    def clear(self):
        self.update(self.none)


def test_calls_to_the_state():
    """Each is a message to the JVM and back."""
    handle, frames = Calls(), state.Frames(10)
    frames.init(handle)

    def calls(*rows):
        before = handle.n
        out = [(r.place, r.frame) for r in frames.handleInputRows((1,), iter([Row(n=n, chunk=c, last=last, at=at) for n, c, last, at in rows]), None)]
        return out, handle.n - before

    assert calls((0, "a\n\n", False, 0), (1, "b\n\n", True, 1)) == ([(0, "a"), (1, "b")], 1)
    assert calls((0, "a\n\n", False, 0)) == ([(0, "a")], 3) and calls((1, "b", False, 5)) == ([], 2) and handle.timers == {10}
    assert calls((2, "c\n\n", True, 6)) == ([(1, "bc")], 3) and not handle.timers
    counter = state.Counter(2, 10)
    counter.init(handle)
    for at, most in ((0, 3), (5, 2)):
        before = handle.n
        list(counter.handleInputRows((1,), iter([Row(place=at, at=at)]), None))
        assert handle.n - before <= most


def test_partitions_of_states(spark):
    old = spark.conf.get(state.PARTITIONS)
    spark.conf.set(state.PARTITIONS, "600")
    try:
        with state.rocksdb(spark):
            assert int(spark.conf.get(state.PARTITIONS)) == 4 * spark.sparkContext.defaultParallelism
        assert spark.conf.get(state.PARTITIONS) == "600"
    finally:
        spark.conf.set(state.PARTITIONS, old)


def test_counts_restart_after_silence(spark, tmp_path):
    rows = lambda ns, at: [("7", n, at + n) for n in ns]
    parts = [rows(range(3), T0), rows(range(3, 6), T0), [("8", 0, T0 + 900_000)], rows(range(6, 10), T0 + 900_000)]
    build = lambda s: state.every_nth(s, "k", "n", 4, silence_ms=60_000, delay="1 second")
    got = arriving(spark, parts, "k string, n long, at long", build, tmp_path).collect()
    assert sorted((r.fired, r.upto) for r in got) == [(1, 3), (1, 9)]  # without the silence the second would come at 7


def test_throttle_and_breaker_across_runs(spark, tmp_path):
    parts = [[(1, 9, T0), (2, 9, T0 + 10)], [(3, 9, T0 + 10), (4, 9, T0 + 20)], [(5, 9, T0 + 1_020), (6, 9, T0 + 90_000)]]
    got = arriving(spark, parts, "event_id long, user_id long, at long", lambda s: state.throttled(s, 1000, 2, delay="1 second"), tmp_path).collect()
    assert {r.event_id: (r.n_recent, r.limited) for r in got} == {1: (1, False), 2: (2, False), 3: (3, True), 4: (4, True), 5: (1, False), 6: (1, False)}
    parts = [[(1, 9, T0, True)], [(2, 9, T0 + 999, True), (3, 9, T0 + 1000, True)], [(4, 9, T0 + 1500, False), (5, 9, T0 + 2000, False)]]
    got = arriving(spark, parts, "event_id long, user_id long, at long, refused boolean", lambda s: state.broken(s, 1000), tmp_path / "b").collect()
    assert {r.event_id: r.skipped for r in got} == {1: False, 2: True, 3: False, 4: True, 5: False}


def test_late_rows_are_dropped_and_the_setting_is_back(spark, tmp_path):
    before = spark.conf.get(state.PROVIDER)
    parts = [[(1, 9, T0)], [(2, 9, T0 + 10_000)], [(3, 9, T0 + 1), (4, 9, T0 + 10_001)]]
    got = arriving(spark, parts, "event_id long, user_id long, at long", lambda s: state.throttled(s, 1000, 5, delay="1 second"), tmp_path).collect()
    assert {r.event_id: r.n_recent for r in got} == {1: 1, 2: 1, 4: 2}
    assert spark.conf.get(state.PROVIDER) == before


def test_bursts_with_a_late_event(spark, tmp_path):
    """Session windows: a late row within the watermark joins its burst, one beyond it doesn't count."""
    s = lambda ms: T0 + ms
    parts = [[(1, s(0)), (1, s(100))], [(1, s(5_000))], [(1, s(4_900)), (1, s(50))], [(9, s(10**9))]]

    def build(rows):
        timed = rows.withColumn("ts", F.timestamp_millis("at")).withWatermark("ts", "1 second")
        return timed.groupBy("u", F.session_window("ts", "150 milliseconds")).agg(F.min("at").alias("first"), F.count("*").alias("n")).drop("session_window")

    got = arriving(spark, parts, "u long, at long", build, tmp_path).collect()
    assert sorted((r.first - T0, r.n) for r in got) == [(0, 2), (4_900, 2)]


# --- logs -----------------------------------------------------------------------------------

def last(spark, path):
    return {r.id: r.n for r in log.latest(spark, str(path), KIND).collect()}


def test_the_last_append_wins(spark, tmp_path):
    for i in range(20):
        path = str(tmp_path / f"log{i}")
        for n in range(3):
            log.append(spark.createDataFrame([("a", n), (f"b{n}", n), (None, 9)], KIND).repartition(3), path)
        assert last(spark, path) == {"a": 2, "b0": 0, "b1": 1, "b2": 2}


def test_order_within_an_append(spark, tmp_path):
    log.append(spark.range(2000, numPartitions=4).select(F.lit("a").alias("id"), F.col("id").alias("n")), str(tmp_path / "log"))
    assert last(spark, tmp_path / "log") == {"a": 1999}


def test_two_writers(spark, tmp_path):
    path, numbers = str(tmp_path / "log"), []
    gate = threading.Barrier(2)

    def met(number):
        """Both writers try the same number first."""
        if number == 0:
            gate.wait(60)

    def write(k):
        for n in range(4):
            numbers.append((log.append(spark.createDataFrame([("a", 10 * k + n), (f"w{k}", n)], KIND), path, met if n == 0 else lambda _: None), 10 * k + n))

    writers = [threading.Thread(target=write, args=(k,)) for k in range(2)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert sorted(n for n, _ in numbers) == list(range(8))
    assert last(spark, path) == {"a": max(numbers)[1], "w0": 3, "w1": 3}


def test_compaction(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = lambda *r: spark.createDataFrame(r, KIND)
    for n in range(3):
        log.append(rows(("a", n), ("b", n)), path)

    def meanwhile(number):
        """An append takes the number that the compaction is about to try."""
        if number == 3:
            log.append(rows(("a", 100)), path)

    assert log.compact(spark, path, KIND, before=meanwhile) == 4
    assert last(spark, path) == {"a": 100, "b": 2}
    log.append(rows(("b", 7)), path)
    assert last(spark, path) == {"a": 100, "b": 7}
    assert log.vacuum(spark, path) == 0  # nothing is old enough
    assert log.vacuum(spark, path, older=0) == 3
    assert last(spark, path) == {"a": 100, "b": 7}
    assert log.compact(spark, path, KIND) == 6 and last(spark, path) == {"a": 100, "b": 7}
    assert log.compact(spark, str(tmp_path / "none"), KIND) is None


def test_logs_of_others(spark, tmp_path):
    """Files without commits, in the order of their times; lines that are no record don't count."""
    folder = tmp_path / "plain"
    folder.mkdir()
    for name, n in (("z.jsonl", 1), ("a.jsonl", 2)):
        (folder / name).write_text(json.dumps({"id": "a", "n": n}) + "\n\n{broken\n")
        time.sleep(0.02)
    assert last(spark, folder) == {"a": 2}


def test_numbers_in_any_store(spark, tmp_path):
    """The way that stores without links take: a rename that fails if the name is taken."""
    folder = log.Folder(spark, str(tmp_path))
    folder.local = False
    assert folder.created("commits/1", "a") and not folder.created("commits/1", "b") and folder.created("commits/2", "é")
    assert (folder.read("commits/1"), folder.read("commits/2"), folder.names("commits")) == ("a", "é", ["1", "2"])


# --- views ----------------------------------------------------------------------------------

def test_view(spark, tmp_path):
    path = str(tmp_path / "view")
    view = views.View(spark, path, "k long, v long, at long, del boolean", "k", "at", share=0.5, retain=0)
    rows = lambda r: spark.createDataFrame(r, "k long, v long, at long, del boolean")
    assert view.table().count() == 0
    view.merge(rows([(k, k, 0, False) for k in range(1000)]), F.col("del"), 0)
    view.merge(rows([(5, 50, 2, False), (5, 40, 1, False), (6, 0, 1, True)]), F.col("del"), 1)
    view.merge(rows([(7, 70, 1, False)]), F.col("del"), 1)  # a batch that ran already
    got = {r.k: r.v for r in view.table().collect()}
    assert len(got) == 999 and got[5] == 50 and 6 not in got and got[7] == 7
    view.merge(rows([(6, 60, 3, False)]), F.col("del"), 2)
    assert {r.k: r.v for r in view.table().collect()}[6] == 60


def test_a_batch_writes_the_keys_that_it_touches(spark, tmp_path):
    path = str(tmp_path / "view")
    view = views.View(spark, path, "k long, v long, at long", "k", "at", retain=0)
    view.merge(spark.range(200_000).select(F.col("id").alias("k"), F.xxhash64("id").alias("v"), F.lit(0).cast("long").alias("at")), None, 0)
    view.merge(spark.createDataFrame([(1, 1, 1)], "k long, v long, at long"), None, 1)
    view.settle()
    kept = log.commits(view.folder)
    base = view.size(kept[0].folder)
    for n in range(2, 6):
        view.merge(spark.createDataFrame([(n, n, n)], "k long, v long, at long"), None, n)
        assert view.size(log.commits(view.folder)[-1].folder) < base / 100
    assert len(view.folder.names("data")) <= len(log.commits(view.folder)) + 1  # what a compaction stands for is gone
    assert view.table().count() == 200_000


# --- folds and lookups ----------------------------------------------------------------------

def test_folds_gather_nothing(spark):
    """A key's state passes from Arrow batch to Arrow batch."""
    n = 60_000
    rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), F.col("id"))
    cuts = folds.greedy_cuts(rows, "k", "id", 40)
    plan = cuts._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    want = {}
    for i in range(n):
        k = "hot" if i % 3 == 0 else f"k{i % 50}"
        w = want.setdefault(k, [])
        if i - (w[-1] if w else 0) >= 40:
            w.append(i)
    got = {}
    for r in cuts.collect():
        got.setdefault(r.k, {})[r.n] = r.cut
    assert {k: [x[i] for i in range(len(x))] for k, x in got.items()} == {k: w for k, w in want.items() if w}


def test_interval_lookup(spark):
    lines = spark.createDataFrame([("a", x) for x in (0.0, 2.0, 3.0, 3.5, 100.0)] + [("b", 5.0), ("c", 1.0), ("c", 1.0)], "k string, s double")
    at = [("a", t) for t in (-1.0, 0.0, 1.999, 2.0, 3.4, 3.5, 99.9, 100.0, 1e300, float("inf"), float("nan"), None)] + [("b", 0.0), ("b", 9.0), ("c", 1.0), ("z", 1.0), (None, 1.0)]
    probes = spark.createDataFrame([(i, *r) for i, r in enumerate(at)], "i long, k string, t double")
    out = joins.interval_lookup(probes, lines, "k", "t", "s", "chapter")
    assert [r.chapter for r in out.orderBy("i").collect()] == [0, 0, 0, 1, 2, 3, 3, 4, 4, 0, 0, 0, 0, 0, 1, -1, -1]
    assert "Cartesian" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "NestedLoop" not in plan


@pytest.mark.parametrize("spread", [1.0, 1e-9, 1e9])
def test_interval_lookup_of_many(spark, spread):
    import bisect
    import random

    rng = random.Random(1)
    starts = {k: sorted(rng.expovariate(1 / spread) ** 3 for _ in range(rng.randrange(1, 300))) for k in range(5)}
    lines = spark.createDataFrame([(k, x) for k, s in starts.items() for x in s], "k long, s double")
    asked = [(k, rng.choice(s) + rng.choice([0, 0, spread, -spread]) * rng.random()) for k, s in starts.items() for _ in range(300)]
    got = joins.interval_lookup(spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "i long, k long, t double"), lines, "k", "t", "s", "c").orderBy("i").collect()
    assert [r.c for r in got] == [max(bisect.bisect_right(starts[k], t) - 1, 0) for k, t in asked]
