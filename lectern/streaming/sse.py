"""Server-sent events: frames between blank lines, deltas in order, an error or the lack of an end spoils the stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed


def failed(payload: Column) -> Column:
    """Whether a payload has an error that isn't null, false, 0 or empty."""
    error = F.try_variant_get(F.try_parse_json(payload), "$.error", "variant")
    kind, text = F.schema_of_variant(error), F.get_json_object(payload, "$.error")
    empty = F.when(kind == "VOID", True).when(kind == "BOOLEAN", text == "false").when(kind == "STRING", text == "").otherwise(F.coalesce(text.try_cast("double") == 0, F.lit(False)))
    return error.isNotNull() & ~F.coalesce(empty, F.lit(True))


def decoded(chunks: DataFrame, key: str, order: str, chunk: str) -> DataFrame:
    """(key, status, text) of each stream: ok, error or truncated; text only if ok."""
    whole = chunks.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, chunk))), lambda x: x[chunk]), "").alias("s"))
    # lines may end in CR LF; payloads are read without white space around them
    frames = F.transform(F.filter(F.split("s", "\r?\n"), lambda line: line.startswith("data:")), lambda line: trimmed(F.substring(line, F.lit(6), F.length(line))))
    rows = whole.select(key, frames.alias("f"))
    bad: Column = F.exists("f", failed)
    done = F.array_contains("f", "[DONE]")
    text = F.array_join(F.filter(F.transform("f", lambda x: F.get_json_object(x, "$.choices[0].delta.content")), lambda x: x.isNotNull()), "")
    status = F.when(bad, "error").when(done, "ok").otherwise("truncated")
    return rows.select(key, status.alias("status"), F.when(status == "ok", text).alias("text"))
