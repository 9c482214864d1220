"""Zip archives as a data source of Spark, and members read by their place in an archive.

    register(spark)
    spark.read.format("archives").option("content", "*.opf META-INF/container.xml").load(folder)

A partition is a group of archives of about `partitionBytes`. Of each archive only its directory is read, once, and the
members that the option `content` names; all others come as rows that say where their bytes lie. fetched() reads those
that a query turns out to need by that place, without the directory. So a query over a few members of large archives
reads these members, and not the archives.

Columns: path; name (null in the row of the archive itself); place, packed, size, method, flags and crc of the member;
content (if asked for); digest (the archive's SHA-256, if the option `digest` is true); error.

Options: suffix (.epub), content (patterns like *.opf, separated by spaces, without regard to case; none), digest
(false), partitionBytes (64 MB), pushdown (false; true only in sessions with spark.sql.python.filterPushdown.enabled, as
archives() sets it): comparisons of path and name with constants are then left to the source, so archives that fail a
test of the path aren't opened, and members that fail one of the name make no row.

Paths are local or shared folders, or those of the stores that pyarrow.fs knows (hdfs, s3, gs). What is wrong with an
archive is the `error` of its row, what is wrong with a member that of the member's.
"""

from __future__ import annotations

import hashlib
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator, Sequence
from fnmatch import translate

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith

SCHEMA = "path string, name string, place long, packed long, size long, method int, flags int, crc long, content binary, digest string, error string"
ARROW = pa.schema([("path", pa.string()), ("name", pa.string()), ("place", pa.int64()), ("packed", pa.int64()), ("size", pa.int64()), ("method", pa.int32()), ("flags", pa.int32()), ("crc", pa.int64()), ("content", pa.binary()), ("digest", pa.string()), ("error", pa.string())])
FETCHED = pa.schema([("path", pa.string()), ("name", pa.string()), ("content", pa.binary()), ("error", pa.string())])
#: Bytes of content in a batch.
BATCH = 8 << 20
LOCAL = re.compile(r"^file:/+")
#: A test that a pushed filter puts to a value.
TESTS: dict[type, Callable] = {
    EqualTo: lambda x, v: x == v, In: lambda x, v: x in v, StringStartsWith: lambda x, v: x.startswith(v), StringEndsWith: lambda x, v: x.endswith(v),
    StringContains: lambda x, v: v in x, IsNotNull: lambda x, v: True}


def located(path: str) -> tuple[FileSystem, str, str]:
    """The file system of a path, its path there, and what to put before paths there to have them whole."""
    if LOCAL.match(path) or "://" not in path:
        return FileSystem.from_uri("file:///")[0], LOCAL.sub("/", path), "file:"
    fs, inner = FileSystem.from_uri(path)
    return fs, inner, path[: len(path.rstrip("/")) - len(inner.rstrip("/"))] if path.rstrip("/").endswith(inner.rstrip("/")) else path.partition("://")[0] + "://"


def passes(tests: list[Filter], column: str, value: str | None) -> bool:
    return all(value is not None and TESTS[type(f)](value, getattr(f, "value", None)) for f in tests if f.attribute == (column,))


class Group(InputPartition):
    """Archives that one task reads."""

    def __init__(self, paths: list[str]) -> None:
        super().__init__(None)
        self.paths = paths


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.suffix = options.get("suffix", ".epub").lower()
        self.content = [re.compile(translate(p.lower())) for p in options.get("content", "").split()]
        self.digest = options.get("digest", "false").lower() == "true"
        self.bytes = int(options.get("partitionBytes", 64 << 20))
        self.tests: list[Filter] = []

    def partitions(self) -> Sequence[InputPartition]:
        fs, inner, prefix = located(self.root)
        info = fs.get_file_info(inner)
        files = [info] if info.type == FileType.File else fs.get_file_info(FileSelector(inner, recursive=True))
        groups, size = [[]], 0
        for f in sorted((f for f in files if f.type == FileType.File and f.path.lower().endswith(self.suffix)), key=lambda f: f.path):
            if not passes(self.tests, "path", prefix + f.path):
                continue
            if groups[-1] and size + f.size > self.bytes:
                groups.append([])
                size = 0
            groups[-1].append(prefix + f.path)
            size += f.size
        return [Group(g) for g in groups]

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path in partition.paths:
            for row in self.archive(path):
                if passes(self.tests, "name", row.get("name")):
                    rows.append(row)
                    size += len(row.get("content") or b"") + 200
                if size >= BATCH:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    def archive(self, path: str) -> Iterator[dict]:
        """The rows of an archive: its own last, as that may have an error."""
        own: dict = {"path": path}
        try:
            fs, inner, _ = located(path)
            with fs.open_input_file(inner) as f:
                own["size"] = f.size()
                if self.digest:
                    own["digest"] = digest_of(f)
                f.seek(0)
                if f.read(4) != b"PK\x03\x04":
                    raise zipfile.BadZipFile("not a zip archive")
                with zipfile.ZipFile(f) as z:
                    for m in z.infolist():
                        if not m.is_dir():
                            yield self.member(path, z, m)
        except Exception as e:  # noqa: BLE001  (damaged, gone or of an unknown form: neither zipfile nor stores have a common class)
            own["error"] = f"{type(e).__name__}: {e}"
        yield own

    def member(self, path: str, z: zipfile.ZipFile, m: zipfile.ZipInfo) -> dict:
        row = {"path": path, "name": m.filename, "place": m.header_offset, "packed": m.compress_size, "size": m.file_size, "method": m.compress_type, "flags": m.flag_bits, "crc": m.CRC}
        if any(p.match(m.filename.lower()) for p in self.content):
            try:
                row["content"] = z.read(m)
            except Exception as e:  # noqa: BLE001  (as above)
                row["error"] = f"{m.filename}: {type(e).__name__}: {e}"
        return row


class PushingReader(ArchiveReader):
    """A reader that takes filters; Spark refuses one in sessions without filter pushdown for Python sources."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if type(f) in TESTS and f.attribute in (("path",), ("name",)):
                self.tests.append(f)
            else:
                yield f


def digest_of(f: pa.NativeFile) -> str:
    h = hashlib.sha256()
    while block := f.read(1 << 20):
        h.update(block)
    return h.hexdigest()


class Archives(DataSource):
    """spark.read.format("archives"); see the module."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return (PushingReader if self.options.get("pushdown", "false").lower() == "true" else ArchiveReader)(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Archives)


def archives(spark: SparkSession, path: str, content: str = "", digest: bool = False) -> DataFrame:
    """The members of the archives under path; see the module."""
    register(spark)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("archives").option("content", content).option("digest", str(digest)).option("pushdown", pushdown).load(path)


def unpacked(f: pa.NativeFile, place: int, packed: int, size: int, method: int, flags: int, crc: int) -> bytes:
    """A member's bytes, by its place."""
    if flags & 1:
        raise ValueError("encrypted")
    head = f.read_at(30, place)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no member at its place")
    data = f.read_at(packed, place + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
    if method == zipfile.ZIP_DEFLATED:
        data = zlib.decompressobj(-15).decompress(data, size + 1)
    elif method != zipfile.ZIP_STORED:
        raise ValueError(f"method {method}")
    if len(data) != size or zlib.crc32(data) != crc:
        raise ValueError("damaged")
    return data


def fetched(members: DataFrame) -> DataFrame:
    """(path, name, content, error): the bytes of members, rows of archives(), each archive opened once."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f = None, None
        for b in batches:
            rows, held = [], 0
            for r in b.to_pylist():
                out = {"path": r["path"], "name": r["name"]}
                try:
                    if r["path"] != path:
                        fs, inner, _ = located(r["path"])
                        path, f = None, fs.open_input_file(inner)
                        path = r["path"]
                    out["content"] = unpacked(f, *(r[c] for c in ("place", "packed", "size", "method", "flags", "crc")))
                except Exception as e:  # noqa: BLE001  (damaged or gone: zlib and the stores have no common class)
                    out["error"] = f"{r['name']}: {type(e).__name__}: {e}"
                rows.append(out)
                held += len(out.get("content") or b"")
                if held >= BATCH:
                    yield pa.RecordBatch.from_pylist(rows, FETCHED)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, FETCHED)

    wanted = members.select("path", "name", "place", "packed", "size", "method", "flags", "crc").filter(F.col("name").isNotNull())
    return wanted.repartition("path").sortWithinPartitions("path", "place").mapInArrow(emit, "path string, name string, content binary, error string")
