"""Queries that run a stream to its end, in steps: rows arrive a part at a time, and each run goes on from a checkpoint."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import kept
from ..streaming import runs, state, views
from . import sequences
from .registry import query

#: The first second of 2024; Spark takes times up to 1970 for late ones.
START = 1_704_067_200_000


@query(sequences.RATE_SQL)
def stream_rate_limit(t):
    at = views.fresh(t.spark, "throttle")
    run = lambda s: runs.appended(state.throttled(s, sequences.DAY, 3), at)
    hits = runs.events(t.spark, t.folder).drop("refused", "event_type")
    return runs.in_steps(hits, F.col("step"), 3, run, "throttle")


@query(f"SELECT user_id, tries, skips FROM ({sequences.BREAKER_SQL})")
def stream_circuit_breaker(t):
    at = views.fresh(t.spark, "breaker")
    run = lambda s: runs.appended(state.broken(s, sequences.COOL), at)
    out = runs.in_steps(runs.events(t.spark, t.folder), F.col("step"), 3, run, "breaker")
    users = t.events.select("event_id", "user_id")
    return out.join(users, "event_id").groupBy("user_id").agg(F.count_if(~F.col("skipped")).alias("tries"), F.count_if("skipped").alias("skips"))


@query("""SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place, 'data: ' || role || ': ' || regexp_replace(text, '[\\r\\n]+', ' ', 'g') AS frame FROM conversations""")
def stream_frames(t):
    """The turns as an event stream, each frame cut in two; halves arrive in different runs, and some chunks after later ones."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    turns = t.conversations.withColumns({"i": F.row_number().over(order) - 1, "of": F.count("*").over(Window.partitionBy("conv_id"))})
    frame = F.concat(F.lit("data: "), "role", F.lit(": "), F.regexp_replace("text", "[\r\n]+", " "), F.lit("\r\n\r\n"))
    half = F.length("f") - 3 - (F.col("conv_id") % 4)  # before or within the line ends that close a frame
    parts = turns.withColumn("f", frame).select("conv_id", "i", "of", F.posexplode(F.array(F.left("f", half), F.substring("f", half + 1, F.length("f")))).alias("j", "chunk"))
    n = (F.col("i") * 2 + F.col("j")).cast("long")
    chunks = parts.select(F.col("conv_id").alias("stream"), n.alias("n"), "chunk", (n == F.col("of") * 2 - 1).alias("last"), (n * 1000 + START).alias("at"))
    chunks = kept(chunks, "chunks")  # else each step numbers and cuts all turns anew
    late = (F.col("stream") % 5 == 0) & (F.col("n") == 2)
    at = views.fresh(t.spark, "frames")
    out = runs.in_steps(chunks, F.when(late, 2).otherwise(F.least(F.lit(2), F.floor((F.col("n") + 1) / 4))), 3, lambda s: runs.appended(state.framed(s), at), "frames")
    return out.filter("not broken").select(F.col("stream").alias("conv_id"), "place", "frame")


@query("""SELECT conv_id, n // 4 AS fired, turn AS upto FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n % 4 = 0""")
def stream_every_fourth(t):
    """A summary is due after every fourth message; what is over counts for the next, also across runs."""
    rows = t.conversations.select("conv_id", "turn", (F.col("turn") * 1000 + START).cast("long").alias("at"))
    at = views.fresh(t.spark, "fourth")
    out = runs.in_steps(rows, F.least(F.lit(2), F.floor(F.col("turn") / 3)), 3, lambda s: runs.appended(state.every_nth(s, "conv_id", "turn"), at), "fourth")
    return out.select(F.col("key").alias("conv_id"), "fired", "upto")


@query(sequences.DEBOUNCE_SQL)
def stream_debounce(t):
    """Bursts by user, each given out once the watermark has passed it; a last row far ahead closes those that are open."""
    own = runs.events(t.spark, t.folder).join(t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts")), "event_id").select("user_id", "ts", "step")
    end = own.agg(F.lit(-1).cast("long").alias("user_id"), (F.max("ts") + F.expr("interval 30 days")).alias("ts"), F.lit(3).alias("step"))
    at = views.fresh(t.spark, "debounce")

    def run(s):
        bursts = s.withWatermark("ts", "1 hour").groupBy("user_id", F.session_window("ts", "2 hours")).agg(F.unix_micros(F.min("ts")).alias("first_us"), F.unix_micros(F.max("ts")).alias("last_us"), F.count("*").alias("n"))
        return runs.appended(bursts.drop("session_window"), at)

    out = runs.in_steps(own.union(end), F.col("step"), 4, run, "debounce")
    return out.filter("user_id >= 0")


@query("SELECT user_id, event_id, \"at\" FROM (SELECT user_id, event_id, epoch_us(ts) // 1000 AS \"at\", row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1")
def stream_last_update(t):
    at = views.fresh(t.spark, "updates")
    rows = runs.events(t.spark, t.folder).select("user_id", "event_id", "at", "step")
    return runs.in_steps(rows, F.col("step"), 3, lambda s: views.kept_up(s, at, "user_id", "event_id"), "updates").table().drop("step")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_live_count(t):
    """A count that is whole after each run."""
    at = views.fresh(t.spark, "counts")
    rows = runs.events(t.spark, t.folder).select("event_type", "step")
    return runs.in_steps(rows, F.col("step"), 3, lambda s: views.counted(s, at, "event_type"), "counts").table()


@query("""SELECT user_id, max(event_id) FILTER (WHERE step = last) AS event_id, last AS step FROM (SELECT user_id, event_id, least(2, (dayofmonth(ts) - 1) // 10)::INT AS step, max(least(2, (dayofmonth(ts) - 1) // 10)::INT) OVER (PARTITION BY user_id) AS last FROM events)
GROUP BY user_id, last""")
def append_log(t):
    """Appends of JSON lines one after the other, with a compaction between: the last record of a user is that of the last append."""
    from ..sources import log

    at = views.fresh(t.spark, "log")
    rows = runs.events(t.spark, t.folder).groupBy("user_id", "step").agg(F.max("event_id").alias("event_id"))
    kind = "user_id long, step int, event_id long"
    for i in range(3):
        log.append(rows.filter(F.col("step") == i), at)
        if i == 1:
            log.compact(t.spark, at, kind, "user_id")
    return log.latest(t.spark, at, kind, "user_id").select("user_id", "event_id", "step")
