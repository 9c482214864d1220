"""Joins on order: as-of, intervals, first matches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import dropped, kept


def asof_backward(left: DataFrame, right: DataFrame, key: str, pos: str, value: str, seq: str, default: Column | None = None) -> DataFrame:
    """left with the value of the last row of right at or before its pos; of equal places, the greatest seq counts.

    Both sides pass one exchange by key and one sort; nothing is multiplied, as it would be by a range join.
    """
    a = left.withColumns({"__side": F.lit(1), "__seq": F.lit(0).cast("long"), "__v": F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(key, pos, F.lit(0).alias("__side"), F.col(seq).cast("long").alias("__seq"), F.col(value).alias("__v"))
    w = Window.partitionBy(key).orderBy(pos, "__side", "__seq").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b, allowMissingColumns=True).withColumn(value, F.last("__v", ignorenulls=True).over(w)).filter("__side = 1").drop("__side", "__seq", "__v")
    return out if default is None else out.withColumn(value, F.coalesce(value, default))


def asof_prefix(rows: DataFrame, key: str, order: str, pos: str, at: Column) -> DataFrame:
    """(key, order): of each key's rows with a place, walked in order up to the first beyond `at`, the last.

    Rows without a place are passed over; if no other is reached, the first of those that were passed counts, and if
    there is none the first of all.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    placed = F.col(pos).isNotNull()
    inside = F.max(F.coalesce(F.col(pos) > at, F.lit(False)).cast("int")).over(w) == 0
    seen = rows.withColumn("__in", F.when(inside & placed, True).when(~inside, False))  # null: passed over
    return seen.groupBy(key).agg(F.coalesce(F.max(F.when(F.col("__in"), F.col(order))), F.min(F.when(F.col("__in").isNull(), F.col(order))), F.min(order)).alias(order))


def interval_lookup(probes: DataFrame, intervals: DataFrame, key: str, t: str, start: str, name: str, salts: int = 16) -> DataFrame:
    """probes with the number of the interval of their key's timeline that t lies in: 0 before the first and for what is no
    finite number, the last past the end, -1 for a key without a timeline. An interval ends where the next one starts.

    A timeline of n intervals is cut into n bins of equal width; an interval goes to the bins that it covers, fewer than
    2 n in all, and meets a probe in an equi-join on key and bin, so neither a timeline nor a key's probes must fit into
    a row or a task. The bins' width and number, a row for each key, are joined first, at `salts` places for each key.
    """
    order = Window.partitionBy(key).orderBy(start)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    own = intervals.select(key, F.col(start).cast("double").alias("__s")).filter(finite(F.col("__s")))
    own = own.withColumns({"__i": (F.row_number().over(order.orderBy("__s")) - 1).cast("long"), "__e": F.lead("__s").over(order.orderBy("__s"))})
    lines = own.groupBy(key).agg(F.min("__s").alias("__from"), F.max("__s").alias("__to"), F.count("*").alias("__n"))
    lines = lines.withColumn("__width", F.when(F.col("__to") > F.col("__from"), (F.col("__to") - F.col("__from")) / F.col("__n")).otherwise(1.0))
    bin_of = lambda x: F.greatest(F.lit(0), F.least(F.col("__n") - 1, F.floor((x - F.col("__from")) / F.col("__width"))))

    dealt = own.join(lines, key).withColumn("__bin", F.explode(F.sequence(bin_of(F.col("__s")), F.coalesce(bin_of(F.col("__e")), F.col("__n") - 1))))
    dealt = dealt.select(F.col(key).alias("__key"), "__bin", "__s", "__e", "__i")
    spread = lines.select(F.col(key).alias("__key"), "__from", "__n", "__width", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("__salt"))
    x = F.col(t).cast("double")
    seen = probes.withColumn("__at", F.when(finite(x), x)).withColumn("__place", F.pmod(F.xxhash64("__at"), F.lit(salts)).cast("int"))
    seen = seen.join(spread, (F.col(key) == F.col("__key")) & (F.col("__place") == F.col("__salt")), "left").drop("__key").withColumn("__b", bin_of(F.col("__at")))
    met = (F.col(key) == F.col("__key")) & (F.col("__b") == F.col("__bin")) & (F.col("__s") <= F.col("__at")) & (F.col("__e").isNull() | (F.col("__at") < F.col("__e")))
    out = seen.join(dealt, met, "left").withColumn(name, F.when(F.col("__n").isNull(), F.lit(-1)).otherwise(F.coalesce("__i", F.lit(0))).cast("long"))
    return out.select(*probes.columns, name)


def interval_index(t: Column, starts: Column) -> Column:
    """The interval of a timeline that t lies in: 0 before the first and for what is no finite number, the last past the
    end, -1 if there is none."""
    finite = t.isNotNull() & ~F.isnan(t) & (F.abs(t) != float("inf"))
    at = F.when(finite, F.size(F.filter(starts, lambda s: s <= t)) - 1).otherwise(0)
    return F.when(F.size(starts) == 0, -1).otherwise(F.greatest(at, F.lit(0)))


def first_match(left: DataFrame, right: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """left with the values of the first row of right that has its key, by order."""
    first = right.groupBy(key).agg(F.min_by(F.struct(order, *values), order).alias("__m"))
    return left.join(first, key, "left").select(*[left[c] for c in left.columns], F.col(f"__m.{order}").alias(order), *[F.col(f"__m.{v}").alias(v) for v in values])


def flattened(rows: DataFrame, key: str, parent: str, root: Column) -> DataFrame:
    """(key, depth, path) of all nodes that roots reach, one equi-join a level until a level is empty; keys are unique."""
    level = rows.filter(root).select(key, F.lit(0).cast("long").alias("depth"), F.col(key).cast("string").alias("path"))
    below = rows.filter(~F.coalesce(root, F.lit(False)))  # a root is no child, so no node is reached twice
    levels = [kept(level, "level")]
    while True:
        up = levels[-1].select(F.col(key).alias("__up"), F.col("depth").alias("__d"), F.col("path").alias("__p"))
        # kept, as the next level and the result read it again
        level = kept(below.join(up, F.col(parent) == F.col("__up")).select(key, (F.col("__d") + 1).alias("depth"), F.concat("__p", F.lit("/"), F.col(key).cast("string")).alias("path")), "level")
        levels.append(level)
        if level.isEmpty():
            out = kept(reduce(DataFrame.union, levels), "tree")
            dropped(*levels)
            return out
