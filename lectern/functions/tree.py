"""Pages as a relation of nodes, and pages rewritten with a span around each utterance.

nodes() gives a row for each element of a page with its place in document order and the last place within it. An element
lies within another if its place is within that range, so what asks for ancestors is a comparison of numbers in Spark:

    skipped     a running maximum of the ends of what is skipped reaches the node
    leaf block  a block outside of that, with text, and without a block among its children
    anchor      its nearest leaf block is the last one that begins before it, if that reaches it (an as-of join); only
                where blocks lie within blocks, the others that reach it are looked at, too

rewritten() wraps utterances in spans, as a reader needs them to follow a voice: it moves nodes and cuts text, never drops
any, and refuses a page whose text it would change. Span numbers run on over all pages: utterances are counted by page
first, a prefix sum over the pages tells where each begins, then pages are written with their own numbers. What the first
pass has cut is kept as bounds, so the second only parses.
"""

from __future__ import annotations

import html
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.windows import dealt
from ..session import kept
from . import segmentation
from .segmentation import BLOCKS, SKIPPED, SKIPPED_CLASSES, SKIPPED_TYPES, VOID, Node, Options, Tree, leaf_blocks, utterance_bounds

NODES = "page_id long, ord int, last int, up int, tag string, attrs map<string,string>, text string"
NODE = pa.schema([("page_id", pa.int64()), ("ord", pa.int32()), ("last", pa.int32()), ("up", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())])
#: Pages that a worker has as trees and texts at once.
SOME = 32
#: Elements whose content is no markup.
RAW = frozenset("script style".split())


# --- nodes ----------------------------------------------------------------------------------

def walk(page: str) -> Iterator[dict]:
    """Rows of a page's elements; only a block without blocks as children carries its text."""
    tree = Tree(page)
    ends: dict[Node, int] = {}
    todo: list[tuple[Node, bool, int | None]] = [(tree.root, False, None)]
    rows = []
    while todo:
        node, done, up = todo.pop()
        inner = [x for x in node.children if not isinstance(x, str)]
        if done:
            ends[node] = max([node.order, *(ends[x] for x in inner)])
            continue
        todo.append((node, True, up))
        todo += [(x, False, node.order) for x in reversed(inner)]
        leaf = node.tag in BLOCKS and not any(x.tag in BLOCKS for x in inner)
        rows.append((node, up, " ".join(node.text().split()) if leaf else None))
    for node, up, text in rows:
        if not node.tag.startswith("#"):
            yield {"ord": node.order, "last": ends[node], "up": up, "tag": node.tag, "attrs": list(node.attrs.items()), "text": text}


def nodes(pages: DataFrame) -> DataFrame:
    """(page_id, ord, last, up, tag, attrs, text): the elements of pages; last: the greatest ord within; up: the parent's."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if page is not None:
                    yield pa.RecordBatch.from_pylist([{"page_id": k} | r for r in walk(page)], NODE)

    return pages.select("page_id", "html").mapInArrow(emit, NODES)


def skips(o: Options = Options()) -> Column:
    """Whether an element is left out with all that it holds."""
    attr = lambda name: F.coalesce(F.col("attrs")[name], F.lit(""))
    by_class = F.arrays_overlap(F.split(attr("class"), r"\s+"), F.array(*map(F.lit, sorted(o.skip_classes)))) if o.skip_classes else F.lit(False)
    return F.col("tag").isin(*SKIPPED) | attr("epub:type").isin(*SKIPPED_TYPES) | by_class


def leaves(tree: DataFrame, o: Options = Options()) -> DataFrame:
    """(page_id, ord, last, tag, text): the leaf blocks among nodes."""
    order = Window.partitionBy("page_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.max(F.when(skips(o), F.col("last"))).over(order)
    seen = tree.withColumn("reach", reach)
    return seen.filter((F.coalesce("reach", F.lit(-1)) < F.col("ord")) & F.col("tag").isin(*BLOCKS) & (F.coalesce("text", F.lit("")) != "")).select("page_id", "ord", "last", "tag", "text")


def anchored(anchors: DataFrame, blocks: DataFrame) -> DataFrame:
    """(page_id, anchor, ord): the leaf block that each anchor (page_id, anchor, ord) is or lies in, else its own place."""
    both = anchors.select("page_id", "ord", "anchor", F.lit(1).alias("side"), F.lit(None).cast("int").alias("last")).unionByName(
        blocks.select("page_id", "ord", F.lit(None).cast("string").alias("anchor"), F.lit(0).alias("side"), "last"))
    w = Window.partitionBy("page_id").orderBy("ord", "side").rowsBetween(Window.unboundedPreceding, 0)
    block = F.struct(F.col("ord").alias("ord"), F.col("last").alias("last"))
    # the last block that began, and how far any block reaches
    seen = both.withColumns({"near": F.last(F.when(F.col("side") == 0, block), ignorenulls=True).over(w), "far": F.max("last").over(w)}).filter("side = 1")
    inside = F.col("near.last") >= F.col("ord")
    plain = seen.filter(F.coalesce(inside | (F.col("far") < F.col("ord")), F.lit(True))).select("page_id", "anchor", F.when(inside, F.col("near.ord")).otherwise(F.col("ord")).alias("ord"))
    # a block within a block has ended, an outer one hasn't
    nested = seen.filter(F.coalesce(~inside & (F.col("far") >= F.col("ord")), F.lit(False))).select("page_id", "anchor", "ord")
    outer = blocks.select(F.col("page_id").alias("p"), F.col("ord").alias("o"), F.col("last").alias("l"))
    found = nested.join(outer, (F.col("page_id") == F.col("p")) & (F.col("o") <= F.col("ord")) & (F.col("l") >= F.col("ord")))
    return plain.union(found.groupBy("page_id", "anchor", "ord").agg(F.max("o").alias("block")).select("page_id", "anchor", F.col("block").alias("ord")))


def named(tree: DataFrame) -> DataFrame:
    """(page_id, anchor, ord): the first element of each id or name."""
    names = F.filter(F.array(F.col("attrs")["id"], F.col("attrs")["name"]), lambda x: x != "")
    return tree.select("page_id", "ord", F.explode(names).alias("anchor")).groupBy("page_id", "anchor").agg(F.min("ord").alias("ord"))


# --- numbers that run on --------------------------------------------------------------------

def running_numbers(rows: DataFrame, key: str, place: str, name: str) -> DataFrame:
    """rows with a number from 0 on over the whole table, by key, then place.

    Rows are counted by key; only these counts are dealt out by ranges of the key and added up, a partition's total being
    one row. Then each row's number is its key's beginning and its place among the key's rows.
    """
    counts = kept(rows.groupBy(key).agg(F.count("*").alias("__n")).repartitionByRange(key).withColumn("__part", F.spark_partition_id()), "counts")
    sizes = counts.groupBy("__part").agg(F.sum("__n").alias("__size"))
    before = sizes.select("__part", (F.sum("__size").over(Window.orderBy("__part")) - F.col("__size")).alias("__before"))  # a row for each partition
    own = F.sum("__n").over(Window.partitionBy("__part").orderBy(key)) - F.col("__n")
    begins = counts.join(F.broadcast(before), "__part").select(F.col(key).alias("__key"), (F.col("__before") + own).alias("__begin"))
    order = F.row_number().over(Window.partitionBy(key).orderBy(place)) - 1
    return rows.withColumn("__place", order).join(begins, F.col(key).eqNullSafe(F.col("__key"))).withColumn(name, (F.col("__begin") + F.col("__place")).cast("long")).drop("__place", "__key", "__begin")


# --- pages with spans -----------------------------------------------------------------------

def markup(node: Node | str) -> str:
    """A node as markup."""
    out, todo = [], [(node, False)]  # nodes, and what is markup or raw already
    while todo:
        x, raw = todo.pop()
        if isinstance(x, str):
            out.append(x if raw else html.escape(x, quote=False))
        elif x.tag.startswith("#"):
            out.append({"#comment": "<!--{}-->", "#pi": "<?{}>", "#decl": "<!{}>"}[x.tag].format(x.attrs["text"]))
        else:
            attrs = "".join(f' {k}="{html.escape(v)}"' for k, v in x.attrs.items())
            out.append(f"<{x.tag}{attrs}>")
            if x.tag not in VOID or x.children:
                todo.append((f"</{x.tag}>", True))
                todo += [(y, x.tag in RAW) for y in reversed(x.children)]
    return "".join(out)


def slices(children: list, bounds: list[int]) -> list[list]:
    """children dealt out to the ranges between bounds of their text: text is cut, an element lies wholly in one range, and
    one without text in the range that its place is in, the last at the end."""
    sizes = [len(x) if isinstance(x, str) else len(x.text()) for x in children]
    out: list[list] = [[] for _ in bounds[1:]]
    at = 0
    for child, size in zip(children, sizes):
        first = min(bisect_right(bounds, at) - 1, len(out) - 1)
        if isinstance(child, str):
            for i in range(first, len(out)):
                a, b = max(bounds[i], at), min(bounds[i + 1], at + size)
                if a < b:
                    out[i].append(child[a - at : b - at])
        else:
            out[first].append(child)
        at += size
    return out


def items(block: Node) -> list[tuple[bool, str]]:
    """A block's children as utterance_bounds() takes them."""
    return [(isinstance(x, str), x if isinstance(x, str) else x.text()) for x in block.children]


def with_spans(page: str, start: int, o: Options, known: list[list[int]] | None = None) -> tuple[str | None, list[dict], str | None]:
    """A page with a span around each utterance of its leaf blocks, numbered from start on; the spans; an error if its text
    would not be the same. known: the bounds of each block's utterances, if they have been taken before."""
    blocks, tree = leaf_blocks(page, o, whole=True)
    before = " ".join(tree.root.text(frozenset()).split())
    taken, todo = set(), [tree.root]
    while todo:
        x = todo.pop()
        taken.add(x.attrs.get("id"))
        todo += [y for y in x.children if not isinstance(y, str)]
    spans, n = [], start
    for i, (order, _, node) in enumerate(blocks):
        bounds = utterance_bounds(items(node), o) if known is None else known[i]
        new = []
        for part in slices(node.children, bounds):
            name = f"mg-{n:06d}"
            while name in taken:
                name += "x"
            taken.add(name)
            span = Node("span", {"id": name}, -1)
            span.children = part
            new.append(span)
            text = " ".join(span.text().split())
            if text:
                spans.append({"id": name, "ord": order, "text": text})
            n += 1
        node.children = new
    if " ".join(tree.root.text(frozenset()).split()) != before:
        return None, [], "rewriting changed the page's text"
    return "".join(markup(x) for x in tree.root.children), spans, None


def span_counts(pages: DataFrame, o: Options = Options()) -> DataFrame:
    """(page_id, html, n, bounds): how many spans each page takes, and where they begin and end in each leaf block."""
    kind = pa.schema([("page_id", pa.int64()), ("html", pa.string()), ("n", pa.int64()), ("bounds", pa.list_(pa.list_(pa.int32())))])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, SOME):
                part = b.slice(i, SOME)
                bounds = [[utterance_bounds(items(node), o) for _, _, node in leaf_blocks(page or "", o)] for page in part.column(1).to_pylist()]
                n = [sum(len(x) - 1 for x in blocks) for blocks in bounds]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1).cast(pa.string()), pa.array(n, pa.int64()), pa.array(bounds, kind.field("bounds").type)], schema=kind)

    return pages.select("page_id", "html").mapInArrow(emit, "page_id long, html string, n long, bounds array<array<int>>")


def rewritten(pages: DataFrame, o: Options = Options()) -> DataFrame:
    """(page_id, html, spans, error): pages with spans whose numbers run on by page_id; rows that share one, or have none, are
    pages of their own."""
    # kept first: ranges are drawn from a sample, for which all pages would be cut once more, and a page must meet its own bounds
    cut = kept(span_counts(segmentation.spread(pages.select("page_id", "html")), o).withColumn("row", F.monotonically_increasing_id()), "cuts")
    counts = kept(cut.select("page_id", "row", "n").repartitionByRange("page_id", "row").withColumn("part", F.spark_partition_id()), "spans")
    sizes = counts.groupBy("part").agg(F.sum("n").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))  # a row for each partition
    own = F.sum("n").over(Window.partitionBy("part").orderBy("page_id", "row")) - F.col("n")
    begins = counts.join(F.broadcast(before), "part").select("row", (F.col("before") + own).alias("begin"))
    kind = pa.schema([("page_id", pa.int64()), ("html", pa.string()), ("spans", pa.list_(pa.struct([("id", pa.string()), ("ord", pa.int32()), ("text", pa.string())]))), ("error", pa.string())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, SOME):
                rows = [(r["page_id"], *with_spans(r["html"] or "", r["begin"], o, r["bounds"])) for r in b.slice(i, SOME).to_pylist()]
                yield pa.RecordBatch.from_pylist([dict(zip(kind.names, r)) for r in rows], kind)

    # a broadcast would grow with the pages, and they would not stay where they are dealt to
    return dealt(cut, "row", 2048).join(begins.hint("merge"), "row").mapInArrow(emit, "page_id long, html string, spans array<struct<id:string,ord:int,text:string>>, error string")
