"""The pipeline's stages and op6's query on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import minhash, pii, queries, toxicity

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, spans string, rep string, sketch string, first string"


def near(texts, size):
    """{doc_id: (sizes, component)} of (doc_id, text): rows of one doc_id are one document."""
    sets = []
    for d, t in texts:
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in WORD.findall(t or "")]
        sets.append((d, {tuple(w[a : a + size]) for a in range(max(1, len(w) - size + 1))} if w else set()))
    up = {d: d for d, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, o in sets[:i]:
            if a is not None and b is not None and s and o and 100 * len(s & o) >= 80 * len(s | o):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return sets, root


@pytest.fixture(scope="module")
def table():
    rng = random.Random(21)
    some = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    base = some(200)
    edited = base.split()
    edited[50] = "other"
    rows = [(1, base), (2, " ".join(edited)), (3, base.replace(" ", "\t\n", 5)), (4, None), (5, ""), (6, None), (7, "one two"), (8, "ONE two"), (9, some(30_000)), (10, f"mail a@b.co {some(20)} 10.0.0.18 4111111111111111"),
            (11, some(60)), (11, some(60)), (12, some(70)), (12, some(70)), (None, base), (None, some(9)), (13, "x" * 60_000), (14, base + " " + some(3))]
    rows[13] = rows[12]  # a repeated row
    rows += [(20, rows[10][1] + " tail"), (21, rows[11][1] + " end")]  # near one text each of document 11
    return rows


@pytest.fixture(scope="module")
def docs(spark, table):
    return spark.createDataFrame([(d, t, "en", "s", len(t) if t is not None else None, "d", "s", "r", "k", "f") for d, t in table], SCHEMA).repartition(3)


def test_near_with_shared_ids(docs, table):
    """Each text of a doc_id links; through document 11 its two neighbours are one group."""
    for size in (2, 5):
        sets, root = near(table, size)
        got = sorted(((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id or 0) for r in minhash.find_near(docs, minhash.Rules(shingle=size)).collect())
        assert got == sorted(((d is None, d or 0), len(s), (root(d) if d is not None else 0) or 0) for d, s in sets)
        assert {root(d) for d in (11, 20, 21)} == {11}


def test_op6_by_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    sets, root = near(rows, 2)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op6_minhash_near_dedup(spark, SF).collect()}
    assert got == {d: (len(s), root(d), root(d) == d) for d, s in sets}


@pytest.fixture(scope="module")
def stages():
    return dict(pytest.importorskip("corpus_pipeline").STAGES)


def rows_of(df):
    return sorted(((r.doc_id is None, r.doc_id or 0, r.text is None, r.text or "") for r in df.collect()))


def as_rows(pairs):
    return sorted((d is None, d or 0, t is None, t or "") for d, t in pairs)


def test_toxicity_stage(spark, docs, table, stages, tmp_path):
    labels = spark.createDataFrame([(d, int(d in (2, 7)), 1) for d in range(1, 15)] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, text int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    out = stages["toxicity"](spark, docs, str(tmp_path))
    index = toxicity.fit(docs, labels)
    wanted = index.scored(pa.array([t for _, t in table]))[0] < 0.7
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert rows_of(out) == as_rows(x for x, ok in zip(table, wanted) if ok)
    assert stages["toxicity"](spark, docs.limit(0), str(tmp_path)).collect() == []


def test_exact_stage(spark, docs, table, stages):
    first = {}
    for d, t in table:
        k = SPACE.sub(" ", t or "")
        first[k] = min(first.get(k, d), d, key=lambda x: (x is None, x or 0))
    want = [(d, t) for d, t in table if first[SPACE.sub(" ", t or "")] == d]
    out = stages["exact dedup"](spark, docs, SF)
    assert rows_of(out) == as_rows(want) and len(out.columns) == 5
    assert stages["exact dedup"](spark, docs.limit(0), SF).collect() == []


def test_near_stage(spark, docs, table, stages):
    _, root = near(table, 5)
    out = stages["minhash near-dedup"](spark, docs, SF)
    assert rows_of(out) == as_rows((d, t) for d, t in table if d is None or root(d) == d) and len(out.columns) == 5
    assert stages["minhash near-dedup"](spark, docs.limit(0), SF).collect() == []


def covered(text, spans):
    """A text with each group of overlapping spans replaced by the first one's kind."""
    out, at = [], 0
    for s in spans:
        if s.start >= at:
            out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = max(at, s.end)
    return "".join(out) + text[at:]


def test_pii_stage(spark, docs, table, stages):
    out = stages["pii"](spark, docs, SF)
    spans = {(d, t): s for d, t, s in pii.with_spans(docs.select("doc_id", "text"), "found").collect()}
    assert rows_of(out) == as_rows((d, None if t is None else covered(t, spans[d, t])) for d, t in table)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out.collect())
    assert any(r.text and "[EMAIL]" in r.text and "4111" not in r.text for r in out.collect())
    assert stages["pii"](spark, docs.limit(0), SF).collect() == []


def pieces_of(out, texts):
    """Checks that pieces are all tokens of texts, in order, each once, in sequences without gaps."""
    import public_tokenizers
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, got = [], {}
    for d, t in texts:
        want.append((d is None, d or 0, [*encode.encode(t or "", add_special_tokens=False).ids, 0]))
    for r in out:
        got.setdefault(r.sequence_id, []).append(r)
    for s in got.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [0, *np.cumsum([r.length for r in s]).tolist()[:-1]] and sum(r.length for r in s) <= 1024
    left = sorted(((r.doc_id is None, r.doc_id or 0, r.doc_tokens, r.start, r.length, r.ids_crc32) for r in out))
    expected = []
    for none, d, ids in want:
        mine = [x for x in left if x[:3] == (none, d, len(ids)) and x[5] == zlib.crc32(np.array(ids[x[3] : x[3] + x[4]], "<u4").tobytes())]
        ends = {0}
        for x in sorted(mine, key=lambda x: x[3]):
            if x[3] in ends:
                ends.add(x[3] + x[4])
        assert len(ids) in ends, d
        expected.append(len(ids))
    assert sum(x[4] for x in left) == sum(expected)


def test_packing_stage(spark, docs, table, stages):
    pieces_of(stages["packing"](spark, docs, SF).collect(), table)
    assert stages["packing"](spark, docs.limit(0), SF).collect() == []


def test_the_whole(spark):
    """run() against the stages' definitions one after the other; only toxicity's scores are the operator's own."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    index = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    scores = {r.doc_id: r.score for r in toxicity.score(docs, index).collect()}
    texts = [(d, t) for d, t in texts if scores[d] < 0.7]
    first = {}
    for d, t in texts:
        first.setdefault(SPACE.sub(" ", t), d)
    texts = [(d, t) for d, t in texts if first[SPACE.sub(" ", t)] == d]
    _, root = near(texts, 5)
    texts = [(d, t) for d, t in texts if root(d) == d]
    kept = spark.createDataFrame(texts, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.detect(kept).collect()}
    pieces_of(corpus_pipeline.run(spark, SF).collect(), [(d, covered(t, spans[d])) for d, t in texts])
    assert len(texts) > 50
