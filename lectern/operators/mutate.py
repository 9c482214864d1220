"""Changes to keyed tables as queries that give the table afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def insert_if_absent(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """table and those of rows whose key it doesn't have."""
    return table.unionByName(rows.join(table.select(key), key, "left_anti"))


def upsert_latest(table: DataFrame, rows: DataFrame, key: str, version: str) -> DataFrame:
    """One row of each key: the newest of rows if it has any, else what is there."""
    both = table.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.col("__new").desc(), F.col(version).desc())
    return both.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__new")


def patch(table: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """table with the fields of patches. For a field x, has_x tells whether the patch sets it, to null if x is null."""
    p = patches.select(key, *[F.col(c).alias(f"__{c}") for c in patches.columns if c != key])
    fields = [c for c in patches.columns if c != key and not c.startswith("has_")]
    out = table.join(p, key, "left")
    return out.select(*[F.when(F.coalesce(F.col(f"__has_{c}"), F.lit(False)), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in table.columns])


def cascade_delete(parents: DataFrame, gone: DataFrame, key: str, *children: tuple[DataFrame, str, str]) -> list[DataFrame]:
    """What stays of parents and of each child table (table, its foreign key, its own key) when `gone` keys go.

    A child goes if its parent, one level up, goes; children of parents that were never there stay.
    """
    out = [parents.join(gone.select(key), key, "left_anti")]
    for child, foreign, own in children:
        lost = child.join(gone.select(F.col(key).alias(foreign)).distinct(), foreign, "left_semi")
        out.append(child.join(gone.select(F.col(key).alias(foreign)).distinct(), foreign, "left_anti"))
        gone, key = lost.select(own), own
    return out


def restore_match(archived: DataFrame, incoming: DataFrame, content: str, key: str, at: str) -> DataFrame:
    """incoming with restored_id: the archived row with equal content that was archived first; null matches nothing."""
    first = archived.filter(F.col(at) > 0).groupBy(content).agg(F.min_by(key, F.struct(at, key)).alias("restored_id"))
    return incoming.join(first, content, "left")


def compare_and_set(table: DataFrame, updates: DataFrame, key: str, version: str, value: Column) -> DataFrame:
    """table with the new value and whether it counts (`proposed`, `applied`): updates whose expected version, null included, is
    the present one and whose value isn't empty."""
    u = updates.select(F.col(key), F.col("expected").alias("__expected"), value.alias("proposed"), F.lit(True).alias("__has"))
    ok = F.col("__has").isNotNull() & F.col(version).eqNullSafe(F.col("__expected")) & (F.coalesce("proposed", F.lit("")) != "")
    return table.join(u, key, "left").withColumn("applied", F.coalesce(ok, F.lit(False))).drop("__expected", "__has")


def archived(table: DataFrame, gone: DataFrame, key: str, payload: str, content: str, at: str, now: Column) -> DataFrame:
    """table after the rows of `gone` keys are put away: time set, payload dropped, its digest kept if there is none yet."""
    marked = table.join(gone.select(key).distinct().withColumn("__gone", F.lit(True)), key, "left")
    away = F.coalesce("__gone", F.lit(False))
    out = marked.withColumn(content, F.when(away, F.coalesce(content, F.sha2(payload, 256))).otherwise(F.col(content)))
    out = out.withColumns({payload: F.when(~away, F.col(payload)), at: F.when(away, now).otherwise(F.col(at))})
    return out.select(table.columns)


def restored(table: DataFrame, incoming: DataFrame, content: str, key: str, at: str, *own: str) -> DataFrame:
    """table after incoming rows are added; one with the content of an archived row brings that row back instead.

    The archived row keeps its key, the fields `own`, and every field that incoming doesn't set; of several rows that
    come in for one archived row the one with the greatest key counts.
    """
    matched = restore_match(table, incoming, content, key, at)
    new = matched.filter("restored_id is null").drop("restored_id")
    fields = [c for c in incoming.columns if c not in (key, at, *own)]
    over = matched.filter("restored_id is not null").groupBy(F.col("restored_id").alias(key)).agg(F.max_by(F.struct(*fields), key).alias("__x"))
    kept = table.join(over, key, "left")
    value = {c: F.coalesce(F.col(f"__x.{c}"), F.col(c)) for c in fields} | {at: F.when(F.col("__x").isNull(), F.col(at))}
    return kept.select(*[value.get(c, F.col(c)).alias(c) for c in table.columns]).unionByName(new, allowMissingColumns=True)
