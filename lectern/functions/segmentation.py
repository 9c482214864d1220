"""Utterances: texts cut at sentence ends, with short pieces merged and long ones split at clause marks.

cuts() gives the same cuts for plain text with column expressions up to the merging of short pieces; splitting long
pieces depends on where the last one was split, so it runs in Arrow batches.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import href_path

# Tags and classes of blocks, and words whose period ends no sentence.
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote div td th figcaption caption pre section article aside header footer main nav ol ul dl table tbody thead tr figure body".split())
SKIPPED = frozenset("script style head title nav rt rp".split())
BREAKS = frozenset("br hr".split())
SKIPPED_TYPES = frozenset("toc landmarks page-list loi lot cover".split())
SKIPPED_CLASSES = frozenset("pg-boilerplate toc".split())
ABBREVIATIONS = frozenset("""
mr mrs ms dr st sta capt col gen lt sgt maj cmdr adm rev hon prof pres gov sen jr sr esq vs etc viz inc ltd co no nos fig figs vol vols ch
chap pp ed eds al ibid cf approx dept univ mt ft ave blvd jan feb mar apr jun jul aug sep sept oct nov dec i.e e.g
""".split())
SENTENCE_END = r"""[.!?…]+[")\]’”']*(?=\s|$)"""
#: HTML elements that never have an end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Options(NamedTuple):
    max_chars: int = 320
    min_chars: int = 40
    skip_classes: frozenset[str] = SKIPPED_CLASSES


# --- column expressions ---------------------------------------------------------------------

def sentences(text: Column) -> Column:
    """Pieces of text, each up to a sentence end, in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?sU).*?{SENTENCE_END}|(?sU).+"), F.lit(0))


def ends_in_abbreviation(word: Column) -> Column:
    """Whether a word before a period is a single letter or a known abbreviation."""
    return (F.length(word) == 1) | F.lower(word).isin(*sorted(ABBREVIATIONS))


def sentence_cuts(text: Column, min_chars: int = 40) -> Column:
    """Ends of sentences, without those closer than min_chars to the last one kept.

    Lambdas don't share repeated expressions, so each pattern runs in a transform of its own, once a piece.
    """
    state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("last"), F.array().cast("array<int>").alias("cuts"))
    word = r"""(?U)(?<![\w.’'])([\w.’']*[\w’'])\.[.!?…]*[")\]’”']*$"""

    def looked(p: Column) -> Column:
        return F.struct(F.length(p).alias("n"), p.rlike(rf"(?U){SENTENCE_END}$").alias("end"), F.regexp_extract(p, word, 1).alias("word"))

    def judged(p: Column) -> Column:
        return F.struct(p["n"].alias("n"), (p["end"] & ~ends_in_abbreviation(p["word"])).alias("real"))

    def step(a: Column, p: Column) -> Column:
        at = a.at + p["n"]
        keep = p["real"] & (at - a.last >= min_chars)
        return F.struct(at.alias("at"), F.when(keep, at).otherwise(a.last).alias("last"), F.when(keep, F.concat(a.cuts, F.array(at))).otherwise(a.cuts).alias("cuts"))

    return F.aggregate(F.transform(F.transform(sentences(text), looked), judged), state, step, lambda a: a.cuts)


# --- Arrow ----------------------------------------------------------------------------------

_PIECE = re.compile(rf".*?{SENTENCE_END}|.+", re.DOTALL)
_PERIOD = re.compile(r"""(?<![\w.’'])([\w.’']*[\w’'])\.[.!?…]*[")\]’”']*$""")
#: Where a long piece may be split, best first: behind a clause mark or a comma before white space, behind a space.
_SPLITS = [re.compile(r"[;:—](?=\s)"), re.compile(r",(?=\s)"), re.compile(" ")]


def ends_sentence(piece: str) -> bool:
    """Whether a piece ends in a sentence end, and not in the period of an initial or an abbreviation."""
    if not re.search(rf"{SENTENCE_END}$", piece):
        return False
    word = _PERIOD.search(piece)
    return word is None or not (len(word[1]) == 1 or word[1].lower() in ABBREVIATIONS)


def parts(piece: str, most: int) -> Iterator[int]:
    """Lengths of the parts of a piece: while it is longer than most, the best and last place to split in reach.

    A mark counts only if the white space behind it is in reach, too. Without a place to split, the rest is one part.
    """
    places = [[m.end() for m in p.finditer(piece)] for p in _SPLITS] if len(piece) > most else []
    at = 0
    while len(piece) - at > most:
        reach = [ends[bisect_right(ends, at + most - (i < 2)) - 1] if ends and ends[0] <= at + most - (i < 2) else 0 for i, ends in enumerate(places)]
        to = next((e for i, e in enumerate(reach) if e > at + (i == 2)), None)
        if to is None:
            break
        yield to - at
        at = to
    yield len(piece) - at


def plain_cuts(text: str, o: Options) -> list[int]:
    """Places where one utterance ends and the next begins: pieces are gathered up to a sentence end past min_chars, and
    what is too long is split."""
    lengths, held = [], ""
    for piece in _PIECE.findall(text):
        held += piece
        if len(held) >= o.min_chars and ends_sentence(piece):
            lengths += parts(held, o.max_chars)
            held = ""
    lengths += parts(held, o.max_chars) if held else ()
    return [x for x in accumulate(lengths) if x < len(text)]


def utterance_bounds(items: list[tuple[bool, str]], o: Options) -> list[int]:
    """Where a block's utterances begin, and where the last one ends. items: (whether it can be cut, text), in order.

    A cut within an item that can't be cut moves to that item's end. An utterance starts where a piece starts that has
    text of its own, which is what is visible in items that can be cut; the first one starts at the block's start.
    """
    whole = "".join(t for _, t in items)
    if not any(free and t.strip() for free, t in items):
        return [0, len(whole)]  # nothing starts; blocks within blocks would be cut as often as they are deep
    ends = list(accumulate(len(t) for _, t in items))
    cuts = set()
    for cut in plain_cuts(whole, o):
        at = bisect_right(ends, cut)  # the item that the cut lies in
        cuts.add(cut if items[at][0] else ends[at])

    def shows(a: int, b: int) -> bool:
        """Whether an item that can be cut has anything visible from a to b."""
        for i in range(bisect_right(ends, a), len(items)):
            free, t = items[i]
            start = ends[i] - len(t)
            if start >= b:
                break
            if free and t[max(a - start, 0) : b - start].strip():
                return True
        return False

    edges = [0, *sorted(cuts - {len(whole)}), len(whole)]
    starts = [a for a, b in zip(edges, edges[1:]) if shows(a, b)]
    return [0, *starts[1:], len(whole)]


def utterances(items: list[tuple[bool, str]], o: Options) -> list[str]:
    """Texts of a block's utterances."""
    whole = "".join(t for _, t in items)
    bounds = utterance_bounds(items, o)
    return [t for t in (" ".join(whole[a:b].split()) for a, b in zip(bounds, bounds[1:])) if t]


class Node:
    __slots__ = ("tag", "attrs", "children", "order")

    def __init__(self, tag: str, attrs: dict, order: int) -> None:
        self.tag, self.attrs, self.children, self.order = tag, attrs, [], order

    def text(self, gaps: frozenset[str] = BREAKS) -> str:
        """All text within, with a space for each element of `gaps`; without recursion, as pages nest deeper than calls may."""
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
                continue
            if x.tag in gaps:
                out.append(" ")
            todo += reversed(x.children)
        return "".join(out)


class Tree(HTMLParser):
    """A tolerant tree of a page: an end tag closes up to its start tag, if there is one."""

    def __init__(self, page: str) -> None:
        super().__init__(convert_charrefs=True)
        self.count = 0
        self.root = Node("html", {}, 0)
        self.open = [self.root]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.count += 1
        node = Node(tag, {k: v or "" for k, v in attrs}, self.count)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag == tag), 0)
        if at:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)

    def hidden(self, tag: str, data: str) -> None:
        """What isn't an element or text takes a place in document order, too."""
        self.count += 1
        self.open[-1].children.append(Node(tag, {"text": data}, self.count))

    def handle_comment(self, data: str) -> None:
        self.hidden("#comment", data)

    def handle_pi(self, data: str) -> None:
        self.hidden("#pi", data)

    def handle_decl(self, decl: str) -> None:
        self.open[-1].children.append(Node("#decl", {"text": decl}, self.count))


def skipped(node: Node, o: Options) -> bool:
    return node.tag in SKIPPED or node.attrs.get("epub:type", "") in SKIPPED_TYPES or bool(set(node.attrs.get("class", "").split()) & o.skip_classes)


def leaf_blocks(page: str, o: Options = Options(), whole: bool = False) -> list[tuple[int, str, Node]] | tuple[list[tuple[int, str, Node]], Tree]:
    """(document order, tag, node) of blocks with text and no block as a child, outside of what is skipped; with `whole` the
    page's tree, too."""
    tree = Tree(page)
    out, todo = [], [tree.root]
    while todo:
        node = todo.pop()
        if skipped(node, o):
            continue
        inner = [x for x in node.children if not isinstance(x, str)]
        if node.tag in BLOCKS and not any(x.tag in BLOCKS for x in inner) and node.text().strip():
            out.append((node.order, node.tag, node))
        todo += reversed(inner)
    out.sort(key=lambda x: x[0])
    return (out, tree) if whole else out


def anchors(page: str, kind: str | None = None) -> list[tuple[int, str | None, str]]:
    """(place, href, label) of the links in the first nav of a page, or the first nav of a kind (epub:type)."""
    todo, out = [Tree(page).root], []
    while todo:
        node = todo.pop()
        if node.tag == "nav" and kind in (None, node.attrs.get("epub:type")):
            inner = [node]
            while inner:
                x = inner.pop()
                if x.tag == "a":
                    out.append((len(out), x.attrs.get("href"), " ".join(x.text().split()) or "Untitled"))
                inner += reversed([y for y in x.children if not isinstance(y, str)])
            return out
        todo += reversed([x for x in node.children if not isinstance(x, str)])
    return out


def _rows(df: DataFrame, key: str, text: str, make, schema: str) -> DataFrame:
    """Rows that make(text) gives for each text, behind its key."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    names = [x.split()[0] for x in schema.split(", ")]
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # slices of about half a MB of text; a longer text is one of its own
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype("int64")
            part_of = size.cumsum() // (1 << 19)
            cuts = [0, *((part_of[1:] != part_of[:-1]).nonzero()[0] + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                part = b.slice(i, j - i)
                out = [(k, *r) for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if t is not None for r in make(t)]
                yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*out) if out else [[]] * len(names), types)], names=names)

    return df.select(key, text).mapInArrow(emit, schema)


def spread(pages: DataFrame) -> DataFrame:
    """pages dealt out by page_id, about 2,048 to a partition.

    However the files are cut, all cores have work, and a worker's batch is no more than such a partition.
    """
    from ..operators.windows import dealt

    return dealt(pages, "page_id", 2048)


def html_blocks(pages: DataFrame, o: Options = Options()) -> DataFrame:
    """(page_id, ord, tag, text): the leaf blocks of each page."""
    return _rows(pages, "page_id", "html", lambda t: [(i, tag, " ".join(n.text().split())) for i, tag, n in leaf_blocks(t, o)], "page_id long, ord int, tag string, text string")


def html_text(pages: DataFrame, key: str = "long") -> DataFrame:
    """(page_id, text): all that is to be read on a page, white space collapsed; key: the type of page_id."""
    def read(page: str) -> list:
        out, todo = [], [Tree(page).root]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in ("script", "style", "head", "title"):
                edge = [" "] if x.tag in BREAKS or x.tag in BLOCKS else []
                todo += [*edge, *reversed(x.children), *edge]
        return [(" ".join("".join(out).split()),)]

    return _rows(pages, "page_id", "html", read, f"page_id {key}, text string")


def page_links(pages: DataFrame, kind: str | None = None, known: DataFrame | None = None) -> DataFrame:
    """(page_id, ord, href, label): links of the first nav (of a kind), without absolute ones; with known (path), only
    those that lead to one of its paths."""
    keep = lambda t: [a for a in anchors(t, kind) if a[1] and not a[1].startswith(("http://", "https://"))]
    links = _rows(pages, "page_id", "html", keep, "page_id long, ord int, href string, label string")
    return links if known is None else links.join(known.select("path").distinct(), href_path("href") == F.col("path"), "left_semi")


def page_anchors(pages: DataFrame, o: Options = Options()) -> DataFrame:
    """(page_id, anchor, ord): the block that each anchor of a page leads to; of equal anchors the first counts."""
    from . import tree

    elements = tree.nodes(pages)
    return tree.anchored(tree.named(elements), tree.leaves(elements, o))


def segment_texts(docs: DataFrame, o: Options = Options()) -> DataFrame:
    """(doc_id, pos, text): utterances of plain texts."""
    return _rows(docs, "doc_id", "text", lambda t: list(enumerate(utterances([(True, t)], o))), "doc_id long, pos int, text string")


def segment_pages(pages: DataFrame, o: Options = Options()) -> DataFrame:
    """(page_id, ord, pos, text): utterances of the leaf blocks of pages."""
    def make(page: str) -> list:
        return [(i, p, t) for i, _, n in leaf_blocks(page, o) for p, t in enumerate(utterances([(isinstance(x, str), x if isinstance(x, str) else x.text()) for x in n.children], o))]

    return _rows(spread(pages.select("page_id", "html")), "page_id", "html", make, "page_id long, ord int, pos int, text string")


def preserved(blocks: DataFrame, segments: DataFrame, keys: list[str], order: list[str], text: str = "text") -> DataFrame:
    """(keys, preserved): whether a block's segments together are its text, but for white space."""
    bare = lambda c: F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", "")
    joined = segments.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(*order, F.col("text").alias("_t")))), lambda x: x["_t"]), "").alias("_all"))
    own = blocks.select(*keys, bare(F.coalesce(text, F.lit(""))).alias("_own"))
    return own.join(joined, keys, "left").select(*keys, (F.col("_own") == bare(F.coalesce("_all", F.lit("")))).alias("preserved"))
