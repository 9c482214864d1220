"""Functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import segmentation


class Utterances:
    def eval(self, text: str) -> Iterator[tuple]:
        if text is not None:
            yield from enumerate(segmentation.utterances([(True, text)], segmentation.Options()))


class LeafBlocks:
    def eval(self, html: str) -> Iterator[tuple]:
        if html is not None:
            for order, tag, node in segmentation.leaf_blocks(html):
                yield order, tag, " ".join(node.text().split())


def register(spark: SparkSession) -> None:
    """Table functions utterances(text) and leaf_blocks(html), for use in LATERAL joins; null gives no rows."""
    spark.udtf.register("utterances", F.udtf(Utterances, returnType="pos int, text string", useArrow=True))
    spark.udtf.register("leaf_blocks", F.udtf(LeafBlocks, returnType="ord int, tag string, text string", useArrow=True))
