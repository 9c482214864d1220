"""EPUB archives as tables.

The archives' directories and their few structural members come from one scan of the data source in archive.py; they
are kept, and so are the XML elements of those members and of the documents that turn out to be needed. Package,
manifest, spine and table of contents are joins and aggregates of these tables:

    rootfile -> package -> metadata
                        -> manifest -> spine
                                    -> navigation documents in turn, else NCX -> table of contents

Only the members that the spine and the contents name are read, by their place. A member must fit into a row. What is
wrong with an archive is its `error`, never the job's.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.segmentation import html_text
from ..functions.text import collapsed, href_fragment, normal_path, trimmed, unescaped
from ..session import dropped, kept
from .archive import archives, fetched

STRUCTURE = "META-INF/container.xml META-INF/encryption.xml *.opf"
ELEMENTS = "path string, name string, ord int, tag string, attrs map<string,string>, text string, above array<int>"
ELEMENT = pa.schema([("path", pa.string()), ("name", pa.string()), ("ord", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string()), ("above", pa.list_(pa.int32()))])
#: Names of the encoding that a document may begin with.
MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
DECLARED = re.compile(rb"""<\?xml[^>]*encoding\s*=\s*["']([\w.:-]+)|<meta[^>]*charset\s*=\s*["']?([\w.:-]+)""", re.IGNORECASE)


def decoded(content: bytes) -> str:
    """A document's text by its mark, by the encoding that it declares, else as UTF-8."""
    named = DECLARED.search(content[:1024])
    encoding = next((e for mark, e in MARKS if content.startswith(mark)), None) or (named and (named[1] or named[2]).decode()) or "utf-8"
    return content.decode(encoding)


def texts(files: DataFrame) -> DataFrame:
    """(path, name, content, error): members as text; error if one can't be read or isn't in its encoding."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                try:
                    r["content"] = None if r["error"] else decoded(r["content"])
                except (UnicodeError, LookupError) as e:
                    r |= {"content": None, "error": f"{r['name']}: {type(e).__name__}: {e}"}
                out.append(r)
            yield pa.RecordBatch.from_pylist(out, pa.schema([(c, pa.string()) for c in ("path", "name", "content", "error")]))

    return files.select("path", "name", "content", "error").mapInArrow(emit, "path string, name string, content string, error string")


def elements(files: DataFrame) -> DataFrame:
    """The elements of XML members in document order: tag and attributes without namespace, all text within, and the
    numbers of the elements that they lie in, from the root on. A member that is no XML has a row without a tag."""

    def walk(e: ElementTree.Element, above: list[int], number: Iterator[int]) -> Iterator[dict]:
        ord_ = next(number)
        yield {"ord": ord_, "tag": e.tag.rpartition("}")[2], "attrs": [(k.rpartition("}")[2], v) for k, v in e.attrib.items()], "text": "".join(e.itertext()), "above": above}
        for child in e:
            yield from walk(child, [*above, ord_], number)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, name, content in zip(*(b.column(c).to_pylist() for c in ("path", "name", "content"))):
                try:
                    rows = list(walk(ElementTree.fromstring(content), [], iter(range(1 << 30))))
                except (ElementTree.ParseError, ValueError, RecursionError, LookupError):
                    rows = [{}]
                yield pa.RecordBatch.from_pylist([{"path": path, "name": name} | r for r in rows], ELEMENT)

    return files.select("path", "name", "content").mapInArrow(emit, ELEMENTS)


def resolved(href: Column, base: Column) -> Column:
    """A link's path in the archive: without fragment, decoded, from the folder of the member that holds it, without
    dots and a slash in front."""
    plain = unescaped(F.substring_index(href, "#", 1))
    folder = F.regexp_extract(base, "^(.*)/[^/]*$", 1)
    return normal_path(F.when(plain.startswith("/"), plain).otherwise(F.concat_ws("/", F.nullif(folder, F.lit("")), plain)))


def first_of(rows: DataFrame, value: Column, order: str, name: str) -> DataFrame:
    """(path, name): each archive's value that comes first."""
    return rows.groupBy("path").agg(F.min_by(value, order).alias(name))


def package(files: DataFrame, xml: DataFrame) -> DataFrame:
    """(path, opf): the package document that the container names, else the only one there is."""
    named = xml.filter("name = 'META-INF/container.xml' and tag = 'rootfile'").select("path", "ord", F.col("attrs")["full-path"].alias("name"))
    named = first_of(named.join(files.select("path", "name"), ["path", "name"], "left_semi"), F.col("name"), "ord", "named")
    only = files.filter(F.lower("name").endswith(".opf")).groupBy("path").agg(F.when(F.count("*") == 1, F.min("name")).alias("only"))
    return named.join(only, "path", "full").select("path", F.coalesce("named", "only").alias("opf")).filter("opf is not null")


def manifest(opf: DataFrame) -> DataFrame:
    """(path, id, href, media, properties, place): items with id and href; the last of equal ids, where the first stood."""
    a = F.col("attrs")
    items = opf.filter("tag = 'item'").select("path", "opf", "ord", a["id"].alias("id"), a["href"].alias("href"), F.coalesce(a["media-type"], F.lit("")).alias("media"), F.split(F.coalesce(a["properties"], F.lit("")), r"\s+").alias("properties"))
    items = items.filter("id <> '' and href <> ''").groupBy("path", "opf", "id").agg(F.max_by(F.struct("href", "media", "properties"), "ord").alias("x"), F.min("ord").alias("ord"))
    return items.select("path", "opf", "id", "ord", "x.*").withColumn("place", resolved(F.col("href"), F.col("opf")))


def spine(opf: DataFrame, items: DataFrame, files: DataFrame) -> DataFrame:
    """(path, ord, idref, place, href): the documents to be read, in order."""
    refs = opf.filter("tag = 'itemref'").select("path", F.col("ord").alias("at"), F.col("attrs")["idref"].alias("id"))
    rows = refs.join(items.filter(F.contains("media", F.lit("xhtml"))), ["path", "id"]).join(files.select("path", F.col("name").alias("place")), ["path", "place"], "left_semi")
    return rows.select("path", F.col("at").alias("ord"), F.col("id").alias("idref"), "place", "href")


def sources(opf: DataFrame, items: DataFrame, files: DataFrame) -> DataFrame:
    """(path, name, source): members that may hold the table of contents, in the order in which they are tried: the
    navigation documents as the manifest has them, then the NCX (source null)."""
    nav = items.filter(F.array_contains("properties", "nav")).select("path", F.col("place").alias("name"), F.col("ord").alias("source"))
    ncx = opf.filter("tag = 'spine'").select("path", F.col("attrs")["toc"].alias("id")).join(items, ["path", "id"]).select("path", F.col("place").alias("name"), F.lit(None).cast("int").alias("source"))
    return nav.union(ncx).join(files.select("path", "name"), ["path", "name"], "left_semi").groupBy("path", "name", "source").count().drop("count")


def contents(xml: DataFrame, files: DataFrame) -> DataFrame:
    """(path, ord, label, place, fragment): the entries of the first source that has any. xml: elements of the sources."""
    lists = xml.filter("source is not null and tag = 'nav' and attrs['type'] = 'toc'").groupBy("path", "name", "source").agg(F.min("ord").alias("within"))
    links = xml.filter("source is not null and tag = 'a'").join(lists, ["path", "name", "source"]).filter("array_contains(above, within)")
    links = links.select("path", "source", "name", "ord", F.col("text").alias("label"), F.col("attrs")["href"].alias("href"))

    # a point's own label and link: the nearest point above them
    points = xml.filter("source is null and tag = 'navPoint'").select("path", "name", "ord")
    inner = xml.filter("source is null and tag in ('navLabel', 'content')").select("path", "name", F.element_at("above", -1).alias("ord"), "tag", "text", "attrs", F.col("ord").alias("at"))
    own = inner.groupBy("path", "name", "ord").agg(F.min_by("text", F.when(F.col("tag") == "navLabel", F.col("at"))).alias("label"), F.min_by(F.col("attrs")["src"], F.when(F.col("tag") == "content", F.col("at"))).alias("href"))
    points = points.join(own, ["path", "name", "ord"]).select("path", F.lit(None).cast("int").alias("source"), "name", "ord", "label", "href")

    entries = links.unionByName(points).filter("href <> '' and not href like 'http://%' and not href like 'https://%'")
    entries = entries.select("path", "source", "ord", F.coalesce(F.nullif(collapsed("label"), F.lit("")), F.lit("Untitled")).alias("label"), resolved(F.col("href"), F.col("name")).alias("place"), href_fragment("href").alias("fragment"))
    entries = entries.join(files.select("path", F.col("name").alias("place")), ["path", "place"], "left_semi")
    best = F.min("source").over(Window.partitionBy("path"))
    return entries.withColumn("best", best).filter("source <=> best").select("path", "ord", "label", "place", "fragment")


def metadata(opf: DataFrame) -> DataFrame:
    """(path, tags, title, creator, publisher, published, description, language, rights): the first text of each that isn't
    blank; of a description what is to be read, at most 2,000 characters."""

    def said(tag: str) -> Column:
        text = trimmed("text")
        return F.min_by(text, F.when((F.col("tag") == tag) & (text != ""), F.col("ord")))

    names = {"title": "title", "creator": "creator", "publisher": "publisher", "date": "published", "language": "language", "rights": "rights"}
    rows = opf.groupBy("path").agg(F.count("tag").alias("tags"), *[said(t).alias(n) for t, n in names.items()], said("description").alias("markup"))
    plain = html_text(rows.filter("markup is not null").select(F.col("path").alias("page_id"), F.col("markup").alias("html")), "string")
    plain = plain.select(F.col("page_id").alias("path"), F.nullif(F.left("text", F.lit(2000)), F.lit("")).alias("description"))
    return rows.drop("markup").join(plain, "path", "left")


def read_epubs(spark: SparkSession, path: str) -> DataFrame:
    """(path, error, file_hash, title, author, publisher, published, description, language, spine, toc): a row for each archive under path."""
    found = kept(archives(spark, path, STRUCTURE, digest=True), "archives")
    files = found.filter("name is not null")
    xml = kept(elements(files.filter(F.expr("content is not null and (name = 'META-INF/container.xml' or lower(name) like '%.opf')"))), "elements")
    opf = kept(xml.join(package(files, xml).withColumnsRenamed({"opf": "name"}), ["path", "name"]).withColumnRenamed("name", "opf"), "packages")
    items = kept(manifest(opf), "manifests")
    order = kept(spine(opf, items, files), "spines")
    tried = kept(sources(opf, items, files), "sources")
    wanted = order.select("path", F.col("place").alias("name")).union(tried.select("path", "name")).distinct()
    read = kept(fetched(files.join(wanted, ["path", "name"], "left_semi")), "members")
    lists = kept(elements(read.join(tried, ["path", "name"], "left_semi").filter("content is not null")).join(tried, ["path", "name"]), "lists")
    text = kept(texts(read.join(order.select("path", F.col("place").alias("name")), ["path", "name"], "left_semi")), "texts")

    meta = metadata(opf)
    locked = files.filter("name = 'META-INF/encryption.xml'").select("path", F.contains(F.decode(F.col("content"), "ISO-8859-1"), F.lit("EncryptedData")).alias("locked"))
    broken = found.select("path", "error").union(read.select("path", "error")).union(text.select("path", "error")).groupBy("path").agg(F.min("error").alias("broken"))
    documents = order.join(text.select("path", F.col("name").alias("place"), "content"), ["path", "place"])
    nested = [t.groupBy("path").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", F.struct(*[F.col(c).alias(n) for c, n in cols.items()]).alias("x")))), lambda e: e.x).alias(name))
              for t, name, cols in ((documents, "spine", {"idref": "idref", "place": "path", "href": "href", "content": "content"}), (contents(lists, files), "toc", {"label": "label", "place": "path", "fragment": "fragment"}))]
    rows = broken.join(found.filter("name is null").select("path", F.col("digest").alias("file_hash")), "path").join(meta, "path", "left").join(locked, "path", "left")
    for t in nested:
        rows = rows.join(t, "path", "left")
    error = (F.when(F.coalesce("locked", F.lit(False)) | F.contains(F.lower(F.coalesce("rights", F.lit(""))), F.lit("drm")), "protected").when(F.col("broken").isNotNull(), F.col("broken"))
             .when(F.coalesce("tags", F.lit(0)) == 0, "no package document"))
    stem = F.regexp_replace(F.regexp_extract("path", "([^/]*)$", 1), r"(?i)\.epub$", "")
    rows = rows.withColumn("error", error)
    ok = lambda x: F.when(F.col("error").isNull(), x)
    out = kept(rows.select(
        "path", "error", "file_hash", ok(F.coalesce("title", stem)).alias("title"), ok(F.coalesce("creator", F.lit("Unknown author"))).alias("author"), *[ok(F.col(c)).alias(c) for c in ("publisher", "published", "description")],
        ok(F.coalesce("language", F.lit("en"))).alias("language"), ok(F.coalesce("spine", F.array())).alias("spine"), ok(F.coalesce("toc", F.array())).alias("toc")), "epubs")
    dropped(found, xml, opf, items, order, tried, read, lists, text)
    return out
