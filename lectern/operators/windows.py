"""Operators on ordered rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import trimmed


def dealt(rows: DataFrame, key: str, most: int = 1 << 19) -> DataFrame:
    """rows dealt out by key to as many partitions as leave about `most` rows in each.

    Windows and aggregates of the key then need no other exchange. Without a number, small partitions are put together by
    their bytes as shuffled, and a task that sorts and counts them needs many times that; here it doesn't grow with the table.
    """
    least = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(least, -(-rows.count() // most)), key)


def rate_limited(hits: DataFrame, key: str, at_ms: str, order: str, window_ms: int = 300_000, most: int = 40) -> DataFrame:
    """hits with n_recent and limited: refused hits count too, and a key that is null or empty is never limited.

    A range frame also holds later rows of the same time, so those are taken off.
    """
    by = Window.partitionBy(key)
    near = F.count("*").over(by.orderBy(at_ms).rangeBetween(-(window_ms - 1), 0))
    same = Window.partitionBy(key, at_ms)
    n = near - F.count("*").over(same) + F.row_number().over(same.orderBy(order))
    named = F.coalesce(F.col(key).cast("string"), F.lit("")) != ""
    return hits.withColumn("n_recent", n.cast("long")).withColumn("limited", named & (F.col("n_recent") > most))


def budget_suffix(rows: DataFrame, key: str, order: str, size: Column, budget: int = 24_000, least: int = 4) -> DataFrame:
    """The newest rows of each key whose sizes add up to no more than budget, but never fewer than `least`.

    Keys with fewer than `least` rows give none.
    """
    newest = Window.partitionBy(key).orderBy(F.col(order).desc())
    total = F.sum(size).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    keep = (total <= budget) | (F.row_number().over(newest) <= least)
    return rows.withColumns({"__k": keep, "__n": F.count("*").over(Window.partitionBy(key))}).filter(f"__k and __n >= {least}").drop("__k", "__n")


def last_n(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    return rows.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def running_timeline(clips: DataFrame, key: str, order: str, samples: Column, gap: float = 0.35, rate: int = 24_000) -> DataFrame:
    """clips with start_s and end_s. Lengths add up as whole samples; the gap after a clip belongs to it."""
    own = samples.cast("long") + int(gap * rate)
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return clips.withColumns({"__own": own}).withColumn("__end", F.sum("__own").over(w)).withColumns({"start_s": (F.col("__end") - F.col("__own")) / rate, "end_s": F.col("__end") / rate}).drop("__own", "__end")


def contiguous(rows: DataFrame, key: str, order: str, start: str, end: str, slack: float = 0.05) -> DataFrame:
    """(key, begins_at_zero, is_contiguous, last_end) of each key's intervals."""
    w = Window.partitionBy(key).orderBy(order)
    step = rows.withColumn("__ok", F.coalesce(F.abs(F.col(start) - F.lag(end).over(w)) <= slack, F.lit(True)))
    return step.groupBy(key).agg((F.abs(F.min_by(start, order)) <= slack).alias("begins_at_zero"), F.bool_and("__ok").alias("is_contiguous"), F.max_by(end, order).alias("last_end"))


def context_around(blocks: DataFrame, key: str, order: str, text: str, at: Column, most: int = 1200) -> DataFrame:
    """(key, context): the block with order = at and its neighbours, outward until each side is longer than most.

    Blank blocks don't count; the block that crosses the limit is kept, and each side is then clipped.
    """
    rows = blocks.withColumn("__at", at)
    body = rows.filter((F.col(order) == F.col("__at")) | (F.col(text) != "")).withColumn("__side", F.signum(F.col(order) - F.col("__at")).cast("int"))
    w = Window.partitionBy(key, "__side").orderBy(F.abs(F.col(order) - F.col("__at"))).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.length(text)).over(w) + F.count("*").over(w) - 1, F.lit(0))
    kept = body.withColumn("__before", before).filter(F.col("__before") <= most)
    joined = lambda side: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("__side") == side, F.struct(order, text)))), lambda x: x[text]), "\n\n")
    sides = kept.groupBy(key).agg(joined(-1).alias("h"), joined(0).alias("b"), joined(1).alias("f"))
    head = F.when(F.length("h") <= most, F.col("h")).otherwise(F.concat(F.lit("…"), F.right("h", F.lit(most))))
    foot = F.when(F.length("f") <= most, F.col("f")).otherwise(F.concat(F.left("f", F.lit(most)), F.lit("…")))
    return sides.select(key, F.array_join(F.filter(F.array(head, F.col("b"), foot), lambda x: x != ""), "\n\n").alias("context"))


def summarised(rows: DataFrame, key: str, order: str, size: Column, done: str, budget: int = 24_000, least: int = 4) -> DataFrame:
    """(key, taken, watermark) of keys with rows past the watermark `done`, a column that is the same for all rows of a key.

    With `least` or more of them, the newest within budget are taken (at least `least`), and the watermark jumps to all
    rows; with fewer it stays.
    """
    by = Window.partitionBy(key)
    past = rows.withColumns({"__i": F.row_number().over(by.orderBy(order)), "__all": F.count("*").over(by)}).filter(F.col("__i") > F.col(done))
    newest = by.orderBy(F.col(order).desc())
    total = F.sum(size).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    past = past.withColumns({"__take": (total <= budget) | (F.row_number().over(newest) <= least), "__n": F.count("*").over(by)})
    ready = F.col("__n") >= least
    return past.groupBy(key).agg(F.count_if(F.col("__take") & ready).alias("taken"), F.max(F.when(ready, F.col("__all")).otherwise(F.col(done))).cast("long").alias("watermark"))


def timeline_verdict(rows: DataFrame, key: str, order: list[str], name: str, start: str, end: str, duration: str, slack: float = 0.05) -> DataFrame:
    """(key, verdict): the first rule that a key's intervals break, or ok.

    invalid: a start, an end or a duration that is no finite number, a start below 0, an end not after it, a duration not
    above 0, or a name that is null or blank; begin: the first doesn't start at 0; unique: names repeat;
    contiguous: one doesn't start where the one before ends; duration: the last end is off by more than a second.
    """
    w = Window.partitionBy(key).orderBy(*order)
    seen = rows.withColumns({"__first": F.row_number().over(w) == 1, "__before": F.lag(end).over(w), "__last": F.lead(end).over(w).isNull()})
    s, e = F.col(start), F.col(end)
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    d = F.col(duration)
    sound = number(s.cast("double")) & number(e.cast("double")) & number(d.cast("double")) & (s >= 0) & (e > s) & (d > 0) & (trimmed(F.col(name).cast("string")) != "")
    off = seen.groupBy(key).agg(
        F.bool_or(~F.coalesce(sound, F.lit(False))).alias("invalid"), F.bool_or(F.col("__first") & (F.abs(s) > slack)).alias("begin"), (F.count_distinct(name) < F.count("*")).alias("unique"),
        F.bool_or(F.abs(s - F.col("__before")) > slack).alias("contiguous"), F.bool_or(F.col("__last") & (F.abs(e - F.col(duration)) > 1)).alias("duration"))
    return off.select(key, F.coalesce(*[F.when(F.col(rule), rule) for rule in ("invalid", "begin", "unique", "contiguous", "duration")], F.lit("ok")).alias("verdict"))


def numbered(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows with a number from 1 on over the whole table, in order, without a task that sees all rows.

    Rows are dealt out by ranges and kept, so that the partition that a row is in holds; the partitions' sizes, one
    number each, tell where each begins.
    """
    from ..session import kept

    parts = kept(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "numbered")
    sizes = parts.groupBy("__part").agg(F.count("*").alias("__size"))
    before = sizes.select("__part", (F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + place).cast("long")).drop("__part", "__before")


def free_id(own: Column, taken: Column) -> Column:
    """own, with as many x behind it as it takes not to be among those taken."""
    tries = F.transform(F.sequence(F.lit(0), F.size(taken)), lambda n: F.concat(own, F.repeat(F.lit("x"), n)))
    return F.element_at(F.filter(tries, lambda x: ~F.array_contains(taken, x)), 1)
