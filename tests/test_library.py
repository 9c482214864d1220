"""Library functions on hand-made cases: nulls, ties, boundaries."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lectern.functions import segmentation, text
from lectern.operators import folds, joins, mutate, windows
from lectern.sources import epub
from lectern.sources.tables import append_json_lines, latest_json_lines
from lectern.streaming import sse


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").orderBy("i").select(*cols).collect()]


def test_text_functions(spark):
    got = values(spark, [(" a  b﻿ ",), ("",), (None,)], "s string", text.collapsed("s"), text.default_text("s", "d"))
    assert got == [("a b", "a  b"), ("", "d"), (None, "d")]
    assert values(spark, [("\U0001f600a",)], "s string", text.utf16_length("s")) == [(3,)]
    assert values(spark, [("A b--C!",), ("!!",), ("x" * 60,)], "s string", text.slug("s")) == [("a-b-c",), ("part",), ("x" * 48,)]
    assert values(spark, [(3661.5,), (59.9,), (float("nan"),), (-4.0,), (3600.0,)], "x double", text.clock("x"), text.spoken("x")) == [
        ("1:01:01", "1 hour 1 minute 1 second"), ("0:59", "59 seconds"), ("0:00", "0 seconds"), ("0:00", "0 seconds"), ("1:00:00", "1 hour")]
    assert values(spark, [("./a/b.x#f+%20g",), ("/c",), ("d#",)], "s string", text.href_path("s"), text.href_fragment("s")) == [("a/b.x", "f+ g"), ("c", None), ("d", None)]
    assert values(spark, [("a/./b/../c",), ("../x",)], "s string", text.normal_path("s")) == [("a/c",), ("x",)]


def test_digest(spark):
    mark = "BOOKDATA_" + "A1" * 8
    long = ["x" * 3000 + "\n\n" + "y" * 3000, "x" * 3000 + ". " + "y" * 3000, "x" * 3000 + " " + "y" * 3000, "x" * 5000, "x" * 4000, "a. " + "x" * 5000]
    got = [r[0] for r in values(spark, [(s,) for s in [f"{mark}\nnote {mark} on  \n  {mark} {mark}\n\n\n\nend", *long]], "s string", text.digest("s"))]
    assert got[0] == "note  on\n\nend"
    assert got[1:] == ["x" * 3000 + "…", "x" * 3000 + ".…", "x" * 3000 + "…", "x" * 4000 + "…", "x" * 4000, "a. " + "x" * 3997 + "…"]


def test_byte_range(spark):
    rows = [("bytes=0-0", 10), ("bytes=5-", 10), ("bytes=-3", 10), ("bytes=-0", 10), ("bytes=9-5", 10), ("bytes=10-", 10), ("bytes=-30", 10), ("x", 10), ("bytes=0-", 0), ("bytes=-", 5)]
    r = text.byte_range("h", F.col("n"))
    assert values(spark, rows, "h string, n long", r.offset, r.length) == [(0, 1), (5, 5), (7, 3), (None, None), (None, None), (None, None), (0, 10), (None, None), (None, None), (None, None)]


def test_hmac(spark):
    import base64
    import hashlib
    import hmac

    for key in (b"k", b"k" * 100):
        want = base64.urlsafe_b64encode(hmac.new(key, b"a\n1", hashlib.sha256).digest()).decode().rstrip("=")
        assert values(spark, [("a\n1",)], "s string", text.hmac_sha256(key, F.col("s"))) == [(want,)]


def test_sentences(spark):
    o = segmentation.Options(max_chars=40, min_chars=5)
    said = 'Mr. R. W. Emerson spoke. "Yes!" he said; and then, after a while, he went on… No.'
    assert segmentation.utterances([(True, said)], o) == ["Mr. R. W. Emerson spoke.", '"Yes!"', "he said;", "and then, after a while, he went on…", "No."]
    assert segmentation.utterances([(True, "a" * 100)], o) == ["a" * 100]
    # a cut within an item that can't be cut moves to its end; one without own text joins the one before
    assert segmentation.utterances([(True, "One here. "), (False, "Two is. Three"), (True, " four.")], o) == ["One here. Two is. Three", "four."]
    texts = ["Short. Longer sentence here. Tail", "Dr. No said no. vs. etc. Then more text followed here.", "", "No end", said * 3]
    cuts = segmentation.sentence_cuts(F.col("s"), 10)
    plain = segmentation.Options(max_chars=10**6, min_chars=10)
    got = values(spark, [(t,) for t in texts], "s string", cuts)
    for t, (c,) in zip(texts, got):
        assert [x for x in c if x < len(t)] == [x for x in segmentation.plain_cuts(t, plain) if x < len(t)]


def test_blocks():
    page = "<body><nav><a href='a.x#f'>A <b>b</b></a><a href='http://z'>z</a></nav><div class='toc'><p>no</p></div><!-- c --><p>One<br>two <i>x</i><script>var a='</p>'</script></p><div>text <p>in</p></div><ul><li>  </ul></body>"
    assert [(tag, " ".join(n.text().split())) for _, tag, n in segmentation.leaf_blocks(page)][0][0] == "p"
    assert [a[1:] for a in segmentation.anchors(page)] == [("a.x#f", "A b"), ("http://z", "z")]


def test_rate_limit(spark):
    hits = [(i, "a", 1000) for i in range(41)] + [(50, "b", 1000), (51, "a", 300_999), (52, "a", 301_000), (60, "", 5), (61, None, 5)]
    df = spark.createDataFrame(hits, "id long, ip string, at long")
    got = {r.id: (r.n_recent, r.limited) for r in windows.rate_limited(df, "ip", "at", "id").collect()}
    assert got[39] == (40, False) and got[40] == (41, True) and got[50] == (1, False) and got[51] == (42, True) and got[52] == (2, False) and not got[60][1] and not got[61][1]


def test_asof(spark):
    left = spark.createDataFrame([(1, "d", 0), (2, "d", 5), (3, "d", 9), (4, "e", 9)], "id long, k string, pos long")
    right = spark.createDataFrame([("d", 5, "a", 1), ("d", 5, "b", 2), ("d", 9, "c", 3)], "k string, pos long, v string, seq long")
    assert {r.id: r.v for r in joins.asof_backward(left, right, "k", "pos", "v", "seq").collect()} == {1: None, 2: "b", 3: "c", 4: None}
    at = values(spark, [(-1.0,), (float("nan"),), (1.999,), (2.0,), (99.0,), (float("inf"),)], "t double", joins.interval_index(F.col("t"), F.array(*map(F.lit, (0.0, 2.0, 3.0)))))
    assert [x[0] for x in at] == [0, 0, 0, 1, 2, 0]  # what isn't finite counts as 0


def test_timeline_and_context(spark):
    clips = spark.createDataFrame([(1, 1, 24000), (1, 2, 12000)], "k long, n long, s long")
    assert [(r.start_s, r.end_s) for r in windows.running_timeline(clips, "k", "n", F.col("s")).orderBy("n").collect()] == [(0.0, 1.35), (1.35, 2.2)]
    b = spark.createDataFrame([(1, i, t) for i, t in enumerate(["far", "x" * 30, "", "here", "y" * 8, "z" * 8, "w"])], "k long, n long, t string")
    assert windows.context_around(b, "k", "n", "t", F.lit(3), 10).collect()[0].context == "…" + "x" * 10 + "\n\nhere\n\n" + "y" * 8 + "\n\n…"


def test_folds(spark):
    hits = spark.createDataFrame([(1, "u", 0, True), (2, "u", 59_999, True), (3, "u", 60_000, False)], "id long, k string, at long, no boolean")
    r = folds.circuit_breaker(hits, "k", "at", "id", F.col("no")).collect()[0]
    assert (r.tries, r.skips, r.open_until) == (2, 1, 60_000)
    cuts = spark.createDataFrame([("u", x) for x in (30, 40, 70, 85)], "k string, at long")
    assert sorted((r.n, r.cut) for r in folds.greedy_cuts(cuts, "k", "at").collect()) == [(0, 40), (1, 85)]


def test_mutations(spark):
    have = spark.createDataFrame([(1, "a", 1), (2, "b", None), (3, "c", 7)], "k long, v string, ver long")
    u = spark.createDataFrame([(1, 1, "new"), (2, None, "new"), (3, 8, "new")], "k long, expected long, x string")
    assert {r.k: r.applied for r in mutate.compare_and_set(have, u, "k", "ver", F.col("x")).collect()} == {1: True, 2: True, 3: False}
    archived = spark.createDataFrame([("p", "h", 9), ("q", "h", 3), ("r", None, 1), ("s", "g", 0)], "id string, h string, at long")
    new = spark.createDataFrame([("h",), (None,), ("g",)], "h string")
    assert {r.h: r.restored_id for r in mutate.restore_match(archived, new, "h", "id", "at").collect()} == {"h": "q", None: None, "g": None}


def test_sse(spark):
    ok = 'data: {"choices":[{"delta":{"content":"a"}}]}\n\nda'
    rows = [("s", 0, ok), ("s", 1, 'ta: {"choices":[{"delta":{"content":"b"}}]}\n\n: k\n\ndata: [DONE]'), ("t", 0, ok), ("e", 0, 'data: {"error":{"message":"x"}}\n\ndata: [DONE]')]
    got = {r.k: (r.status, r.text) for r in sse.decoded(spark.createDataFrame(rows, "k string, n int, c string"), "k", "n", "c").collect()}
    assert got == {"s": ("ok", "ab"), "t": ("truncated", None), "e": ("error", None)}
    line = lambda extra, end: "data:" + end[:-1].replace("\n", " ") + '{' + extra + '"choices":[{"delta":{"content":"a"}}]}' + end
    rows = [(f"{i}", 0, line(f'"error":{e},', "\r\n\r\n") + "data: [DONE]\t\r\n\r\n") for i, e in enumerate(["false", "null", "0", '""', "true", "1", '"false"', '"0"', "{}", "[]"])]
    got = {r.k: (r.status, r.text) for r in sse.decoded(spark.createDataFrame(rows, "k string, n int, c string"), "k", "n", "c").collect()}
    assert got == {f"{i}": ("ok", "a") if i < 4 else ("error", None) for i in range(10)}


def test_archive_and_restore(spark):
    have = spark.createDataFrame([(1, "t", "body", None, None, 5), (2, "u", None, "h2", 7, 6)], "id long, title string, file string, hash string, archived long, added long")
    away = {r.id: r for r in mutate.archived(have, have.filter("id = 1"), "id", "file", "hash", "archived", F.lit(9).cast("long")).collect()}
    assert (away[1].file, away[1].archived, len(away[1].hash)) == (None, 9, 64) and away[2] == (2, "u", None, "h2", 7, 6)
    new = spark.createDataFrame([(8, "w", "again", "h2", 1), (9, "v", "b", "h9", 1)], "id long, title string, file string, hash string, added long")
    back = {r.id: tuple(r) for r in mutate.restored(have, new, "hash", "id", "archived", "added").collect()}
    assert back == {1: (1, "t", "body", None, None, 5), 2: (2, "w", "again", "h2", None, 6), 9: (9, "v", "b", "h9", None, 1)}


def test_timeline_verdict(spark):
    """Shifted starts and a wrong duration, as a player's checks see them."""
    good = [(1, 0.0, 10.0), (2, 10.0, 20.0), (3, 20.0, 30.0)]
    cases = {"ok": (good, 30.5), "duration": (good, 35.0), "contiguous": ([good[0], (2, 11.0, 20.0), good[2]], 30.0), "begin": ([(1, 1.0, 10.0), *good[1:]], 30.0), "unique": ([good[0], (1, 10.0, 20.0)], 20.0), "invalid": ([good[0], (2, 10.0, 10.0)], 10.0)}
    nan, inf = float("nan"), float("inf")
    bad = [[(1, None, 10.0)], [(1, 0.0, None)], [(1, nan, 10.0)], [(1, 0.0, nan)], [(1, 0.0, inf)], [(None, 0.0, 10.0)]]
    cases |= {f"invalid {i}": (c, 10.0) for i, c in enumerate(bad)} | {f"invalid {d}": ([(1, 0.0, 10.0)], d) for d in (None, nan, inf, -1.0)}
    rows = [(k, i, *c, d) for k, (cs, d) in cases.items() for i, c in enumerate(cs)]
    df = spark.createDataFrame(rows, "k string, i long, id long, s double, e double, d double")
    assert {r.k: r.verdict for r in windows.timeline_verdict(df, "k", ["i"], "id", "s", "e", "d").collect()} == {k: k.split()[0] for k in cases}


def test_timelines_are_dealt_by_their_rows(spark):
    """A task's rows don't grow with the table, and no exchange puts small partitions together afterwards."""
    rows = spark.range(1000).select((F.col("id") % 300).alias("k"))
    dealt = windows.dealt(rows, "k", 10)
    assert dealt.rdd.getNumPartitions() == 100 and dealt.groupBy("k").count().count() == 300 and dealt.count() == 1000
    for name in ("timeline_verdict", "timeline_validate"):
        plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan.replace("SinglePartition, ENSURE_REQUIREMENTS", ""), plan


def test_prefix_and_intervals(spark):
    rows = [("a", 1, 1.0), ("a", 2, None), ("a", 3, 9.0), ("b", 1, None), ("b", 2, 9.0), ("c", 1, 9.0), ("c", 2, None), ("d", 1, None), ("d", 2, 2.0)]
    df = spark.createDataFrame(rows, "k string, n long, pos double")
    assert {r.k: r.n for r in joins.asof_prefix(df, "k", "n", "pos", F.lit(5.0)).collect()} == {"a": 1, "b": 1, "c": 1, "d": 2}
    assert values(spark, [(3.0,)], "t double", joins.interval_index(F.col("t"), F.array().cast("array<double>"))) == [(-1,)]


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    assert all(r.n == r.k + 1 for r in windows.numbered(df, "n", "k").collect())
    assert values(spark, [("a", ["a", "ax"]), ("a", ["b"]), ("a", [])], "s string, t array<string>", windows.free_id(F.col("s"), F.col("t"))) == [("axx",), ("a",), ("a",)]


def test_anchors_and_integrity(spark):
    """An anchor within a heading belongs to the heading; utterances of blocks, by the last anchor before them."""
    page = "<html><body><p>Introduction.</p><h2><a id='ch1'></a>Chapter One.</h2><p>First body.</p><h2><a name='ch2'></a>Chapter Two.</h2><p>Second body.<!-- c --> More.</p><nav id='x'></nav></body></html>"
    pages = spark.createDataFrame([(1, page)], "page_id long, html string")
    blocks = segmentation.html_blocks(pages)
    at = segmentation.page_anchors(pages).select("page_id", "anchor", F.col("ord").cast("long").alias("ord"), F.col("ord").alias("seq"))
    order = {r.text: r.ord for r in blocks.collect()}
    assert {r.anchor: r.ord for r in at.collect()}.items() >= {"ch1": order["Chapter One."], "ch2": order["Chapter Two."]}.items()
    seg = segmentation.segment_pages(pages, segmentation.Options(min_chars=0)).withColumn("ord", F.col("ord").cast("long"))
    got = joins.asof_backward(seg, at.filter("anchor <> 'x'"), "page_id", "ord", "anchor", "seq").orderBy("ord", "pos").collect()
    assert [(r.anchor, r.text) for r in got] == [(None, "Introduction."), ("ch1", "Chapter One."), ("ch1", "First body."), ("ch2", "Chapter Two."), ("ch2", "Second body."), ("ch2", "More.")]
    check = segmentation.preserved(blocks, segmentation.segment_pages(pages), ["page_id", "ord"], ["pos"])
    assert check.count() == 5 and check.filter("not preserved").isEmpty()
    assert segmentation.preserved(blocks, segmentation.segment_pages(pages).filter("text <> 'First body.'"), ["page_id", "ord"], ["pos"]).filter("not preserved").count() == 1
    links = spark.createDataFrame([(1, "<nav><a href='no.x'>n</a></nav><nav epub:type='toc'><a href='a.x#f'>A</a><a href='b.x'>B</a></nav>")], "page_id long, html string")
    known = spark.createDataFrame([("a.x",)], "path string")
    assert [(r.href, r.label) for r in segmentation.page_links(links, "toc", known).collect()] == [("a.x#f", "A")]


def test_sql_functions(spark):
    from lectern.functions.register import register

    register(spark)
    got = spark.sql("SELECT u.pos, u.text FROM VALUES ('One sentence of some length, which is here. And another of some length, there.'), (null) AS t(x), LATERAL utterances(x) u").collect()
    assert [tuple(r) for r in got] == [(0, "One sentence of some length, which is here."), (1, "And another of some length, there.")]
    assert spark.sql("SELECT b.tag FROM LATERAL leaf_blocks('<p>a</p><ul><li>b</ul>') b").count() == 2


def test_json_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text("\n".join([json.dumps({"id": "a", "n": 1}), "", json.dumps({"id": "b", "n": 2}), json.dumps({"id": "a", "n": 3})]))
    assert {r.id: r.n for r in latest_json_lines(spark, str(tmp_path), "id string, n long").collect()} == {"a": 3, "b": 2}
    more = spark.createDataFrame([("c", 4)], "id string, n long")
    for n in (1, 2, 4):
        append_json_lines(more.withColumn("n", F.lit(n)), str(tmp_path / "log"))
    assert [tuple(r) for r in latest_json_lines(spark, str(tmp_path / "log"), "id string, n long").collect()] == [("c", 4)]


CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>'
PACKAGE = """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title> T </dc:title></metadata><manifest>
<item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="c" href="toc.ncx"/></manifest>
<spine toc="c"><itemref idref="a"/><itemref idref="zz"/></spine></package>"""
NAV = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:e="http://www.idpf.org/2007/ops"><body><nav e:type="toc"><a href="/o/a.xhtml#s%201">One  x</a><a href="http://z">z</a></nav></body></html>'
NCX = '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>N</text></navLabel><content src="a.xhtml"/></navPoint></navMap></ncx>'


@pytest.mark.parametrize("nav", [True, False])
def test_epub(spark, tmp_path, nav):
    def archive(files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n, x in files.items():
                z.writestr(n, x)
        return out.getvalue()

    files = {"META-INF/container.xml": CONTAINER, "o/p.opf": PACKAGE, "o/a.xhtml": "<p/>", "o/toc.ncx": NCX} | ({"o/nav.xhtml": NAV} if nav else {})
    (tmp_path / "a.epub").write_bytes(archive(files))
    (tmp_path / "b.epub").write_bytes(b"no")
    (tmp_path / "c.epub").write_bytes(archive({"x": ""}))
    (tmp_path / "d.epub").write_bytes(archive(files | {"META-INF/encryption.xml": "<e><EncryptedData/></e>"}))
    hidden = bytearray(archive(files))  # the flag of an encrypted member, in its directory entry
    hidden[hidden.index(b"PK\x01\x02") + 8] |= 1
    (tmp_path / "e.epub").write_bytes(bytes(hidden))
    (tmp_path / "f.epub").write_bytes(archive({"p.opf": PACKAGE.replace("<dc:title> T </dc:title>", ""), "a.xhtml": "<p/>"}))
    got = {r.path[-6:]: r for r in epub.read_epubs(spark, str(tmp_path)).collect()}
    a = got["a.epub"]
    assert (a.error, a.title, a.language, [s.path for s in a.spine]) == (None, "T", "en", ["o/a.xhtml"])
    assert [tuple(e) for e in a.toc] == ([("One x", "o/a.xhtml", "s 1")] if nav else [("N", "o/a.xhtml", None)])
    assert got["b.epub"].error and got["c.epub"].error and got["d.epub"].error == "protected" and "encrypted" in got["e.epub"].error
    assert (got["f.epub"].title, got["f.epub"].author, [s.path for s in got["f.epub"].spine]) == ("f", "Unknown author", ["a.xhtml"])


def test_sentence_cuts_agree_with_the_arrow_form(spark):
    """Marks, closers that are word characters too, abbreviations and initials, at the ends of short pieces."""
    tails = ["a.", "a.’", "a..’ b", "a.’. b", "a.?’.’ b", "a?. b", "a?’. b", ".a. b", "’. b", "Dr. b", "e.g. b", "vs.) b", "Etc.” b", "end.. b", "x.y. b", "1. b", "…. b", "é. b", "word! b", "", " ", "no end"]
    texts = [h + t for h in ("", "One two three. ", "Mr. ") for t in tails]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, s string")
    got = {r["i"]: r["c"] for r in rows.select("i", segmentation.sentence_cuts(F.col("s"), 1).alias("c")).collect()}
    options = segmentation.Options(max_chars=10**6, min_chars=1)
    for i, t in enumerate(texts):
        assert [c for c in got[i] if c < len(t)] == [c for c in segmentation.plain_cuts(t, options) if c < len(t)], t


def test_flattened_depth(spark):
    """All levels of a tree, and an end where a root names itself as its parent."""
    rows = spark.createDataFrame([(i, i - 1) for i in range(2, 11)] + [(1, 1), (20, 99)], "id long, up long")
    got = {r.id: (r.depth, r.path) for r in joins.flattened(rows, "id", "up", F.col("id") == 1).collect()}
    assert got == {i: (i - 1, "/".join(map(str, range(1, i + 1)))) for i in range(1, 11)}
