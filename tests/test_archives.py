"""Archives as a data source, and EPUBs read through it."""

import hashlib
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern.sources import archive, epub

CONTAINER = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>'
META = "<dc:title>\n   Moby\n</dc:title>"
PACKAGE = """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata>{meta}</metadata><manifest>
<item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="n" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>
<item id="m" href="nav2.xhtml" media-type="application/xhtml+xml" properties="x nav"/><item id="c" href="toc.ncx"/></manifest><spine toc="c"><itemref idref="a"/></spine></package>"""
NAV = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:e="http://www.idpf.org/2007/ops"><body><nav e:type="toc">{}</nav></body></html>'
NCX = '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>N</text></navLabel><content src="a.xhtml"/></navPoint></navMap></ncx>'
BOOK = {"META-INF/container.xml": CONTAINER, "o/p.opf": PACKAGE.format(meta=META), "o/a.xhtml": "<p>é</p>", "o/toc.ncx": NCX}


def packed(files, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for n, x in files.items():
            z.writestr(n, x)
    return out.getvalue()


def read(spark, folder, **books):
    for name, files in books.items():
        (folder / f"{name}.epub").write_bytes(files if isinstance(files, bytes) else packed(files))
    return {r.path.rpartition("/")[2][:-5]: r for r in epub.read_epubs(spark, str(folder)).collect()}


def test_directory_and_members(spark, tmp_path):
    files = {f"d/{i}.txt": f"text {i} " * (i * 50) for i in range(20)}
    (tmp_path / "a.epub").write_bytes(b"")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "b.EPUB").write_bytes(packed(files))
    (tmp_path / "c.epub").write_bytes(packed(files, zipfile.ZIP_STORED))
    (tmp_path / "d.zip").write_bytes(b"no")
    rows = archive.archives(spark, str(tmp_path), content="D/1*.txt", digest=True).collect()
    own = {r.path.rpartition("/")[2]: r for r in rows if r.name is None}
    assert set(own) == {"a.epub", "b.EPUB", "c.epub"} and own["a.epub"].error and not own["c.epub"].error
    assert own["c.epub"].digest == hashlib.sha256((tmp_path / "c.epub").read_bytes()).hexdigest()
    members = [r for r in rows if r.name]
    assert len(members) == 40 and all((r.content is not None) == r.name.startswith("d/1") for r in members)
    assert all(bytes(r.content).decode() == files[r.name] for r in members if r.content is not None)
    got = archive.fetched(archive.archives(spark, str(tmp_path)).filter("name like 'd/%7.txt'")).collect()
    assert sorted((r.path[-6:], r.name, bytes(r.content).decode()) for r in got) == sorted((p, n, files[n]) for p in ("b.EPUB", "c.epub") for n in ("d/7.txt", "d/17.txt"))


def test_filters_reach_the_source(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.epub").write_bytes(packed({"x.opf": "1", "y.txt": "2", "z.opf": "3"}))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        found = archive.archives(spark, str(tmp_path)).filter(F.col("name").endswith(".opf") & F.col("path").endswith("b.epub") & (F.col("size") > 0))
        assert sorted(r.name for r in found.collect()) == ["x.opf", "z.opf"]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "EndsWith" not in plan.partition("Filter")[2].partition("BatchScan")[0] or "PushedFilters" in plan
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = archive.PushingReader({"path": str(tmp_path)})
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringEndsWith

    assert [type(f) for f in reader.pushFilters([EqualTo(("name",), "x.opf"), GreaterThan(("size",), 0), StringEndsWith(("path",), "b.epub")])] == [GreaterThan]
    parts = reader.partitions()
    assert [p.rpartition("/")[2] for g in parts for p in g.paths] == ["b.epub"]
    assert [n for g in parts for batch in reader.read(g) for n in batch.column("name").to_pylist()] == ["x.opf"]
    assert len(archive.ArchiveReader({"path": str(tmp_path), "partitionBytes": "1"}).partitions()) == 2


def test_damaged_members_are_rows(spark, tmp_path):
    data = bytearray(packed({"a.txt": "a" * 50, "b.txt": "b" * 50}, zipfile.ZIP_STORED))
    data[data.index(b"a" * 50)] = ord("x")
    (tmp_path / "a.epub").write_bytes(bytes(data))
    got = {r.name: r for r in archive.fetched(archive.archives(spark, str(tmp_path))).collect()}
    assert "damaged" in got["a.txt"].error and bytes(got["b.txt"].content) == b"b" * 50


def test_metadata(spark, tmp_path):
    meta = META + """<dc:creator> </dc:creator><dc:creator>H. M.</dc:creator><dc:publisher>P</dc:publisher><dc:date>1851</dc:date>
    <dc:description>&lt;p&gt;A  &lt;b&gt;whale&lt;/b&gt; &amp;amp; more&lt;/p&gt;</dc:description>"""
    got = read(spark, tmp_path, a=BOOK | {"o/p.opf": PACKAGE.format(meta=meta)}, b=BOOK | {"o/p.opf": PACKAGE.format(meta="<dc:title> \n </dc:title>" + f"<dc:description>{'x' * 3000}</dc:description>")})
    a, b = got["a"], got["b"]
    assert (a.title, a.author, a.publisher, a.published, a.description, a.language) == ("Moby", "H. M.", "P", "1851", "A whale & more", "en")
    assert (b.title, b.author, b.publisher, b.description) == ("b", "Unknown author", None, "x" * 2000)
    assert a.file_hash == hashlib.sha256((tmp_path / "a.epub").read_bytes()).hexdigest()


def test_encodings(spark, tmp_path):
    latin = "<?xml version='1.0' encoding='ISO-8859-1'?><p>\xe9</p>".encode("latin-1")
    got = read(spark, tmp_path, a=BOOK, b=BOOK | {"o/a.xhtml": latin}, c=BOOK | {"o/a.xhtml": b"<p>\xe9</p>"}, d=BOOK | {"o/a.xhtml": "<p>\xe9</p>".encode("utf-16")}, e=BOOK | {"o/a.xhtml": b"<?xml encoding='no-such'?>"})
    assert "<p>é</p>" in got["a"].spine[0].content and "<p>é</p>" in got["b"].spine[0].content and "<p>é</p>" in got["d"].spine[0].content
    assert got["c"].error.startswith("o/a.xhtml") and got["c"].spine is None and got["e"].error


def test_contents_of_the_first_document_that_has_some(spark, tmp_path):
    link = "<a href='a.xhtml#100%'>One</a><a href='%zz'>no</a><a href='a.xhtml#x+%20y'>Two</a>"
    two = BOOK | {"o/nav.xhtml": NAV.format("<a href='http://z'>z</a>"), "o/nav2.xhtml": NAV.format(link)}
    got = read(spark, tmp_path, a=two, b=BOOK | {"o/nav.xhtml": NAV.format("")}, c=BOOK | {"o/nav.xhtml": "<not xml"})
    assert [tuple(e) for e in got["a"].toc] == [("One", "o/a.xhtml", "100%"), ("Two", "o/a.xhtml", "x+ y")]
    assert [tuple(e) for e in got["b"].toc] == [tuple(e) for e in got["c"].toc] == [("N", "o/a.xhtml", None)]


def test_one_scan(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(packed(BOOK))
    plan = epub.read_epubs(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "MapInArrow" not in plan


@pytest.mark.parametrize("link", ["100%", "%zz", "a%2"])
def test_bad_escapes(spark, link):
    from lectern.functions import text

    row = spark.range(1).select(text.unescaped(F.lit(link)).alias("u"), text.href_fragment(F.lit(f"a#{link}")).alias("f"), epub.resolved(F.lit(link), F.lit("o/p.opf")).alias("r")).collect()[0]
    assert (row.u, row.f, row.r) == (link, link, f"o/{link}")
