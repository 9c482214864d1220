"""Every query against its SQL in DuckDB, on the smallest tables; the driver's contract."""

import math

import duckdb
import pytest

import __spark_entry__
from lectern.functions import segmentation

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return repr(v)


@pytest.mark.parametrize("name", sorted(__spark_entry__.registry.SQL))
def test_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    out = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in out.fetchall())
    assert got == want


@pytest.mark.parametrize("name,first,turns", [("dense_part_ids", 9_999, 3), ("dense_part_ids", 5, 10_002), ("running_span_ids", 0, 1_000_003)])
def test_long_numbers(spark, tmp_path, name, first, turns):
    """Ids of more digits than their width, as the SQL gives them."""
    path = str(tmp_path / "conversations.parquet")
    rows = spark.range(turns * 2 if turns < 10 else turns).selectExpr(f"{first} + id div {turns} AS conv_id", f"id % {turns} AS turn", "'user' AS role", "if(id = 1, ' ', 'x') AS text")
    rows.write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    cols = __spark_entry__.queries()[name](spark, str(tmp_path)).columns
    got = __spark_entry__.queries()[name](spark, str(tmp_path)).orderBy("conv_id", "turn").toPandas()
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({__spark_entry__.oracle_sql()[name]}) ORDER BY conv_id, turn").fetchdf()
    assert len(got) == len(want) and (got.values == want.values).all()


def test_rows_only(spark):
    for name in ("html_text", "html_blocks", "page_links", "segment_pages", "anchor_blocks"):
        assert __spark_entry__.queries()[name](spark, SF).count() > 0, name


def brute_utterances(text, most=320, least=40):
    """Utterances character by character."""
    short = segmentation.ABBREVIATIONS
    cuts, last, i = [], 0, 0
    while i < len(text):
        if text[i] in ".!?…":
            j = i
            while j < len(text) and text[j] in ".!?…":
                j += 1
            while j < len(text) and text[j] in "\")]’”'":
                j += 1
            if j == len(text) or text[j].isspace():
                word = ""
                if text[i] == ".":
                    k = i
                    while k and (text[k - 1].isalnum() or text[k - 1] in "_.’'"):
                        k -= 1
                    word = text[k:i].rstrip(".").lower()
                if len(word) != 1 and word not in short and j - last >= least:
                    cuts.append(j)
                    last = j
                i = j
                continue
        i += 1
    out, a = [], 0
    for b in sorted({*cuts, len(text)}):
        while b - a > most:
            spots = [[x + 1 for x in range(a, a + most - 1) if text[x] in m and text[x + 1].isspace()] for m in (";:—", ",")] + [[x + 1 for x in range(a + 1, a + most) if text[x] == " "]]
            spot = next((s[-1] for s in spots if s), None)
            if spot is None:
                break
            out.append(text[a:spot])
            a = spot
        out.append(text[a:b])
        a = b
    return [x for x in (" ".join(x.split()) for x in out) if x]


def test_segmentation_queries(spark):
    """The queries on documents against a plain walk over each text."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = {i: brute_utterances(t) for i, t in texts.items()}
    for name in ("segment_documents", "sql_utterances"):
        got = {}
        for r in __spark_entry__.queries()[name](spark, SF).collect():
            got.setdefault(r.doc_id, {})[r.pos] = r.text
        assert {i: [x[p] for p in sorted(x)] for i, x in got.items()} == {i: x for i, x in want.items() if x}, name
    for r in __spark_entry__.queries()["reading_flagship"](spark, SF).collect():
        own = want[r.doc_id]
        samples = sum(int(max(len(x) / 14.5, 0.2) * 24000) + 8400 for x in own)
        assert (r.segments, r.chars) == (len(own), sum(map(len, own))) and abs(r.seconds - samples / 24000) < 0.001
    for r in __spark_entry__.queries()["sentence_split"](spark, SF).collect():
        cuts = [x for x in map(int, filter(None, r.cuts.split(","))) if x < len(texts[r.doc_id])]
        whole = brute_utterances(texts[r.doc_id], 10**9)
        assert [x for x in (" ".join(texts[r.doc_id][a:b].split()) for a, b in zip([0, *cuts], [*cuts, None])) if x] == whole


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
