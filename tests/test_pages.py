"""Queries on pages against definitions spelled out over a flat list of elements, and pages rewritten with spans."""

import hashlib
import html
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lectern.functions import segmentation, tree

SF = "/root/testdata/sf0.001"
TOKEN = re.compile(r"<!--(.*?)-->|<\?([^>]*)>|<!([^>]*)>|<(/?)([a-zA-Z][\w-]*)((?:\s+[\w:-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+))?)*)\s*/?>", re.DOTALL)
ATTR = re.compile(r"([\w:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


def flat(page):
    """Elements as [ord, up, tag, attrs], and texts as (elements that are open, text), with breaks as a space."""
    elements, texts, open_, at, count = [[0, None, "html", {}]], [], [0], 0, 0
    while at < len(page):
        if elements[open_[-1]][2] in ("script", "style"):
            end = re.search(rf"</{elements[open_[-1]][2]}\s*>", page[at:])
            to = at + end.start() if end else len(page)
            texts.append((list(open_), page[at:to]))
            if end:
                at += end.end()
                open_.pop()
                continue
            break
        m = TOKEN.search(page, at)
        to = m.start() if m else len(page)
        if to > at:
            texts.append((list(open_), html.unescape(page[at:to])))
        if not m:
            break
        at = m.end()
        if m[1] is not None or m[2] is not None:
            count += 1
        elif m[5] and m[4]:
            tag = m[5].lower()
            i = next((i for i in range(len(open_) - 1, 0, -1) if elements[open_[i]][2] == tag), 0)
            if i:
                del open_[i:]
        elif m[5]:
            count += 1
            tag = m[5].lower()
            elements.append([count, open_[-1], tag, {a.lower(): html.unescape(next((v for v in x if v), "")) for a, *x in ATTR.findall(m[6] or "")}])
            if tag in segmentation.BREAKS:
                texts.append(([*open_, len(elements) - 1], " "))
            if tag not in segmentation.VOID:
                open_.append(len(elements) - 1)
    return elements, texts


def over(elements, i):
    """An element and those that it lies in."""
    while i is not None:
        yield i
        i = elements[i][1]


def leaves(elements, texts):
    """{element: text} of leaf blocks, by definition."""
    out = {}
    for i, (_, _, tag, _) in enumerate(elements):
        bad = any(t in segmentation.SKIPPED or a.get("epub:type", "") in segmentation.SKIPPED_TYPES or set(a.get("class", "").split()) & segmentation.SKIPPED_CLASSES for _, _, t, a in (elements[k] for k in over(elements, i)))
        text = " ".join("".join(t for o, t in texts if i in o).split())
        if tag in segmentation.BLOCKS and not bad and text and not any(up == i and t in segmentation.BLOCKS for _, up, t, _ in elements):
            out[i] = text
    return out


@pytest.fixture(scope="module")
def pages(spark):
    return {r.page_id: flat(r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}


def rows(spark, name):
    return __spark_entry__.queries()[name](spark, SF).collect()


def test_blocks(spark, pages):
    want = {(p, e[i][0], e[i][2], text) for p, (e, t) in pages.items() for i, text in leaves(e, t).items()}
    assert {(r.page_id, r.ord, r.tag, r.text) for r in rows(spark, "html_blocks")} == want and want


def test_text(spark, pages):
    for r in rows(spark, "html_text"):
        e, t = pages[r.page_id]
        out = []
        for i, (o, text) in enumerate(t):
            before = t[i - 1][0] if i else []
            # a block's edge lies between two texts if one of them is in a block that the other isn't in
            edge = any(e[k][2] in segmentation.BLOCKS for k in {*o} ^ {*before})
            hidden = any(e[k][2] in ("script", "style", "head", "title") for k in o)
            out.append((" " if edge else "") + ("" if hidden else text))
        assert r.text.replace(" ", "") == "".join("".join(out).split()), r.page_id
        assert r.text == " ".join("".join(out).split())


def test_links(spark, pages):
    want = set()
    for p, (e, t) in pages.items():
        nav = next((i for i, x in enumerate(e) if x[2] == "nav"), None)
        links = [i for i, x in enumerate(e) if x[2] == "a" and nav in over(e, i)] if nav is not None else []
        for n, i in enumerate(links):
            href = e[i][3].get("href")
            if href and not href.startswith(("http://", "https://")):
                want.add((p, n, href, " ".join("".join(x for o, x in t if i in o).split()) or "Untitled"))
    assert {(r.page_id, r.ord, r.href, r.label) for r in rows(spark, "page_links")} == want


def test_anchor_blocks(spark, pages):
    want = set()
    for p, (e, t) in pages.items():
        known = leaves(e, t)
        for i, x in enumerate(e):
            block = next((k for k in over(e, i) if k in known), i)
            want.add((p, f"{x[2]}-{x[0]}", e[block][0]))
    got = rows(spark, "anchor_blocks")
    assert {(r.page_id, r.anchor, r.ord) for r in got} == want and len(got) == len(want)
    assert sum(f"-{r.ord}" != r.anchor[r.anchor.rindex("-"):] for r in got) > 50  # anchors within blocks


def test_segment_pages(spark, pages):
    """Utterances of a block together are its text; those of blocks without elements are as short as they must be."""
    got = {}
    for r in rows(spark, "segment_pages"):
        got.setdefault((r.page_id, r.ord), {})[r.pos] = r.text
    want = {(p, e[i][0]): text for p, (e, t) in pages.items() for i, text in leaves(e, t).items()}
    assert set(got) == set(want)
    full = {(p, e[up][0]) for p, (e, _) in pages.items() for _, up, _, _ in e if up is not None}
    for k, x in got.items():
        parts = [x[i] for i in range(len(x))]
        assert "".join(parts).replace(" ", "") == want[k].replace(" ", "")
        assert k in full or all(len(y) <= 320 for y in parts)


def test_pages_are_spread(spark):
    """However pages are stored, no task and no batch of a worker has more than about 2,048 of them."""
    table = spark.range(0, 10_000, 1, 1).select(F.col("id").alias("page_id"), F.lit("<p>One. Two.</p>").alias("html"))
    out = segmentation.segment_pages(table, segmentation.Options(min_chars=0))
    assert out.rdd.getNumPartitions() == 5 and out.count() == 20_000
    assert tree.rewritten(table).rdd.getNumPartitions() == 5


ODD = """<html><body><p>One sentence.<!-- marker --> Tail text.<?keep yes?></p><div>loose <p id='mg-000001'>A. <b>Two. Three</b> four.<br> End.</p></div>
<p><b>only</b></p><p><i></i> <br></p><p>x &amp; &lt;y&gt; <span>in <div>block in span</div> out</span> tail.</p><script>if (a < b) "</p>"</script><p class='toc'>skip. me.</p><ul><li>  <li>b</ul></body></html>"""


def test_rewritten(spark):
    o = segmentation.Options(min_chars=0)
    table = spark.createDataFrame([(1, "<p>First. Second.</p>"), (2, ODD), (3, None), (4, ""), (5, "<p>Last.</p>")], "page_id long, html string")
    got = {r.page_id: r for r in tree.rewritten(table, o).collect()}
    assert all(r.error is None for r in got.values()) and [s.id for s in got[1].spans] == ["mg-000000", "mg-000001"] and got[3].spans == []
    page = got[2].html
    assert "<!-- marker -->" in page and "<?keep yes?>" in page and "<br>" in page and '"</p>"</script>' in page and "x &amp; &lt;y&gt;" in page
    ids = re.findall(r'<span id="(mg-\d+x*)">', page)
    assert len(ids) == len(set(ids)) and ids[0] == "mg-000002" and set(s.id for s in got[2].spans) <= set(ids)
    assert " ".join(s.text for s in got[2].spans if s.ord == got[2].spans[0].ord) == "One sentence. Tail text."
    # the same text, and the same elements but for spans, as before
    for old, new in ((ODD, page),):
        (e, t), (f, u) = flat(old), flat(new)
        assert "".join(x for _, x in t).split() == "".join(x for _, x in u).split()
        assert [x[2] for x in e if x[2] != "span"] == [x[2] for x in f if x[2] != "span"]
    assert [(s.id, s.text) for s in got[5].spans] == [(f"mg-{2 + len(ids):06d}", "Last.")]
    taken = tree.with_spans("<p id='mg-000000'><a name='q' id='mg-000000x'></a>T.</p>", 0, o)
    assert [s["id"] for s in taken[1]] == ["mg-000000xx"]


def test_bounds_are_taken_once(spark, monkeypatch):
    """What the count of spans has cut is what the pages are written with."""
    o = segmentation.Options(min_chars=0)
    own = tree.span_counts(spark.createDataFrame([(1, ODD)], "page_id long, html string"), o).first()
    want = tree.with_spans(ODD, 2, o)
    monkeypatch.setattr(tree, "utterance_bounds", None)
    assert own.n == sum(len(x) - 1 for x in own.bounds) > 5 and tree.with_spans(ODD, 2, o, own.bounds) == want


DEEP = "<html><body><article>" + "".join(f"<p class='c'><b>Paragraph {i} is here. <br>" for i in range(600)) + "</article>Tail.</body></html>"


def test_deep_pages(spark):
    """Paragraphs that are left open lie within each other, deeper than Python's calls may; each is a block with all within."""
    table = spark.createDataFrame([(1, "<p>First.</p>"), (2, DEEP), (3, "<p>Last.</p>")], "page_id long, html string")
    got = {r.page_id: r for r in tree.rewritten(table).collect()}
    texts = [f"Paragraph {i} is here." for i in range(600)]
    assert [s.text for s in got[2].spans] == [" ".join(texts[i:]) for i in range(600)] and got[2].error is None
    assert [s.id for s in got[2].spans] == [f"mg-{i:06d}" for i in range(1, 601)] and got[3].spans[0].id == "mg-000601"
    assert got[2].html == "".join(["<html><body><article>", *(f'<p class="c"><span id="mg-{i + 1:06d}"><b>Paragraph {i} is here. <br>' for i in range(600)), "</b></span></p>" * 600, "</article>Tail.</body></html>"])
    assert segmentation.segment_pages(table).filter("page_id = 2").count() == segmentation.html_blocks(table).filter("page_id = 2").count() == 600
    assert segmentation.html_text(table).filter("page_id = 2").first().text == " ".join([*texts, "Tail."])
    assert tree.nodes(table).filter("page_id = 2 and tag = 'p'").agg(F.max(F.length("text"))).first()[0] == len(" ".join(texts))


def test_pages_that_share_an_id(spark):
    """Each row is a page of its own, with its own bounds, and numbers run on over them all."""
    o = segmentation.Options(min_chars=0)
    odd = ["<p>One. Two.</p><p>Three.</p>", "<p>Four.</p>", "<p>Four.</p>", "<ul><li>Five. Six.<li>Seven.</ul>", ""]
    table = spark.createDataFrame([(k, x) for k in (2, None, 1) for x in odd], "page_id long, html string")
    got = sorted(tree.rewritten(table, o).collect(), key=lambda r: (r.page_id or 0, [s.id for s in r.spans]))
    want = sorted((k, " ".join(x["text"] for x in tree.with_spans(x, 0, o)[1])) for k in (0, 1, 2) for x in odd)
    assert sorted((r.page_id or 0, " ".join(s.text for s in r.spans)) for r in got) == want and not any(r.error for r in got)
    assert [s.id for r in got for s in r.spans] == [f"mg-{i:06d}" for i in range(3 * (3 + 1 + 1 + 1))]


def test_span_pages(spark, pages):
    got = {r.page_id: r for r in rows(spark, "span_pages")}
    segments = {}
    for r in rows(spark, "segment_pages"):
        segments.setdefault(r.page_id, []).append((r.ord, r.pos, r.text))
    n = 0
    for p in sorted(pages):
        own = [x for _, _, x in sorted(segments.get(p, []))]
        assert got[p].error is None and got[p].n_spans == len(own) and got[p].text_sha256 == hashlib.sha256("\n".join(own).encode()).hexdigest()
        if own:
            assert got[p].first_id == f"mg-{n:06d}"
        n += len(own)
    assert n > 100


def test_numbered_segments(spark):
    got = sorted(((r.doc_id, r.pos), r.n, r.span_id) for r in rows(spark, "numbered_segments"))
    assert [n for _, n, _ in got] == list(range(len(got))) and got[17][2] == "mg-000017"
    assert {k for k, _, _ in got} == {(r.doc_id, r.pos) for r in rows(spark, "segment_documents")}
    odd = spark.createDataFrame([(k, p) for k in (None, 3, 1) for p in (5, 2)], "k long, p long")
    assert [(r.k, r.p, r.n) for r in tree.running_numbers(odd, "k", "p", "n").orderBy("n").collect()] == [(None, 2, 0), (None, 5, 1), (1, 2, 2), (1, 5, 3), (3, 2, 4), (3, 5, 5)]


def test_blocks_within_blocks(spark):
    page = "<p>one <span>two <div id='d'>three</div> <a id='a'></a>four</span></p><p id='e'> </p><div class='toc'><p id='s'>x</p></div>"
    table = spark.createDataFrame([(1, page)], "page_id long, html string")
    got = {r.anchor: r.ord for r in segmentation.page_anchors(table).collect()}
    order = {r.tag + str(r.ord): r.ord for r in tree.nodes(table).collect()}
    assert got == {"d": order["div3"], "a": order["p1"], "e": order["p5"], "s": order["p7"]}
    assert tree.nodes(table).filter(F.col("last") < F.col("ord")).isEmpty()
