"""Each operator against a brute-force version, on rows with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import automaton, bpe, chat, components, embedding, exact, minhash, packing, pii, queries, repeats, suffix, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, spans string, sketch string, node long, rep long, digest string"


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """(doc_id, text) with shared passages, copies, near copies, periodic, empty, null and long texts."""
    rng = random.Random(7)
    out = []
    shared = [words(rng, 60) for _ in range(4)]
    base = words(rng, 300)
    for i in range(70):
        kind = i % 7
        if kind == 0:
            out.append(f"{words(rng, rng.randrange(5, 80))} {shared[i % 4]} {words(rng, 30)}")
        elif kind == 1:
            w = base.split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = "edit"
            out.append(" ".join(w))
        elif kind == 2:
            out.append(out[-2])
        elif kind == 3:
            out.append("ab " * rng.randrange(60) + "é\t\tDer  Fuß" * rng.randrange(4))
        elif kind == 4:
            out.append(None if i % 2 else "")
        elif kind == 5:
            out.append(f"  {shared[1]}\n{shared[2][:200]}  ")
        else:
            out.append(words(rng, rng.randrange(30)))
    out.append(" ".join(words(rng, 5000) + " " + base for _ in range(2)))
    out.append("x" * 3000 + " " + "xy" * 700)
    return list(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "s", "k", 1, 2, "d") for i, t in corpus], DOCS).repartition(3)


def rows(df, key):
    out = {r[key]: r for r in df.collect()}
    return out


def ascii_words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# --- 1 ---

def test_chat(spark):
    turns = [(1, 0, "system", "be <| nice"), (1, 1, "user", "hi"), (1, 2, "user", "<\\|im_end|>"), (1, 3, "assistant", "a\n<|turn|>"), (1, 4, "assistant", None),
             (1, 4, "assistant", None), (2, 5, None, "x"), (2, 5, "a\nb<|im_start|>", "\\<\\\\|"), (2, 6, "<\\n|", "t"), (2, 7, "<\\\\n|<\n|\n<\\|n", "u"), (2, 8, "\n", "v"), (3, None, "assistant", ""), (None, 1, "assistant", "nü\U0001f600")]
    df = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, turns string")
    out = chat.format_chats(df)
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.parse_chats(out).collect()}
    want = defaultdict(list)
    for c, n, r, t in sorted(turns, key=lambda x: (str(x[0]), x[1] or 0, x[2] or "", x[3] or "")):
        want[c].append((r or "", t or ""))
    assert got == dict(want)
    masked = {r.conv_id: r.m for r in out.select("conv_id", chat.loss_text().alias("m")).collect()}
    assert masked == {c: "".join(t for r, t in w if r == "assistant") for c, w in want.items()}
    one = out.filter("conv_id = 1").collect()[0].formatted
    assert one.count("<|im_start|>") == 3 and one.count("<|turn|>") == 3 and one.count("<|im_end|>") == 3
    assert chat.format_chats(df.limit(0)).count() == 0


# --- 2 ---

def brute_padding(at, cost, window):
    total = [0] + [None] * (len(at) - 1)
    for j in range(1, len(at)):
        total[j] = min(total[i] + window - (at[j] - at[i]) + cost[j] for i in range(j) if at[j] - at[i] <= window)
    return min(total[i] for i in range(len(at) - 1) if at[-1] - at[i] <= window)


def test_cut_is_optimal():
    rng = random.Random(3)
    for _ in range(200):
        window = rng.choice([8, 16, 64])
        at = [0]
        for _ in range(rng.randrange(1, 60)):
            at.append(at[-1] + rng.randrange(1, window // 2))
        cost = [rng.randrange(5) for _ in at]
        out = packing.cut(at, cost, window)
        assert out[-1] == at[-1] and out == sorted(set(out))
        edges = [0, *out]
        assert all(0 < b - a <= window for a, b in zip(edges, edges[1:]))
        spent = sum(window - (b - a) + cost[at.index(b)] for a, b in zip(edges, edges[1:-1]))
        assert spent == brute_padding(at, cost, window)
    assert packing.cut([0], [0], 8) == []


def test_packing(spark, docs, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    extra = spark.createDataFrame([(900, "a<|endoftext|>b", *"ab", 1, 1, "c"), (901, " \n\n  " + "q" * 4000, *"ab", 1, 1, "c")], DOCS)
    every = dict(corpus) | {900: "a<|endoftext|>b", 901: " \n\n  " + "q" * 4000}
    want = {i: [*tk.encode(t or "", add_special_tokens=False).ids, 0] for i, t in every.items()}
    got = queries.packed(docs.union(extra)).collect()
    by, seq = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append(r)
    for i, ids in want.items():
        at = 0
        for r in sorted(by[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    padding = 0
    for s in seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding <= 0.01 * sum(map(len, want.values()))
    assert queries.packed(docs.limit(0)).count() == 0


def test_packing_ids(spark):
    """The query's ids against the library's, with the file that is named, on a whole table."""
    import public_tokenizers
    from tokenizers import Tokenizer

    folder = "/root/testdata/sf0.01"
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: [*tk.encode(r.text or "", add_special_tokens=False).ids, 0] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    n = Counter()
    for r in queries.op2_packing(spark, folder).collect():
        ids = want[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids)
        n[r.doc_id] += r.length
    assert n == {i: len(x) for i, x in want.items()}


# --- 3 ---

def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, d[::-1]))) % 10 == 0


def base_spans(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def pii_texts():
    rng = random.Random(5)
    bits = ["a@b.c", "x.y@z", "@", ".", "1.2.3.4", "300.1.2.3", "000255.0.0.1", "4111 1111 1111 1111", "4111111111111112", "+1 (555) 010-9999", "+12", " ", "-", "é\U0001f600", "5", "_d@e.f-g.h", "mail ", "ssn 123-45-6789",
            "123-45-6789", "DE89370400440532013000", "iban GB82 WEST 1234 5698 7654 32", "\n", "+4930123456789", "a" * 50]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(1500)] + [None, "", "1" * 20000, "a" * 30000 + "@b", "+1" + " " * 20000, "1.2." * 3000]


def test_pii(spark):
    texts = pii_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("__m0x", F.lit(1))
    names = ("email", "ip", "card", "phone")
    for r in pii.detect(df).collect():
        got = [(s.start, names.index(s.kind), s.end) for s in r.spans if s.kind in names]
        assert got == base_spans(texts[r.doc_id] or ""), texts[r.doc_id]
    kinds = Counter(s.kind for r in pii.detect(df).collect() for s in r.spans)
    assert kinds["iban"] and kinds["ssn"]
    one = spark.createDataFrame([(1, "mail a@b.co or +1 555 010 9999.", 7), (2, None, 1), (3, "IBAN DE89370400440532013000, ssn: 123-45-6789", 0)], "doc_id long, text string, n_chars long")
    assert [r.text for r in pii.redact(one).orderBy("doc_id").collect()] == ["mail [EMAIL] or [PHONE].", None, "IBAN [IBAN], ssn: [SSN]"]
    assert pii.detect(df.limit(0)).count() == 0
    clash = one.withColumns({"spans": F.lit("s"), "SPANS_EMAIL": F.lit("e"), "__spans": F.lit("t")})
    assert [(*r[3:], r.text) for r in pii.redact(clash).orderBy("doc_id").collect()] == [("s", "e", "t", t) for t in ("mail [EMAIL] or [PHONE].", None, "IBAN [IBAN], ssn: [SSN]")]


def test_pii_overlaps(spark):
    """No character of a span stays, also where spans overlap."""
    texts = ["10.0.0.18 4111111111111111", "x 10.0.0.18 4111111111111111 y +1 555 010 9999", *pii_texts()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows(pii.redact(df), "doc_id")
    overlaps = 0
    for r in pii.detect(df).collect():
        t, out, at = texts[r.doc_id], [], 0
        if t is None:
            assert got[r.doc_id].text is None
            continue
        for s in r.spans:
            if s.start >= at:
                out += [t[at : s.start], f"[{s.kind.upper()}]"]
            else:
                overlaps += s.end > at
            at = max(at, s.end)
        assert got[r.doc_id].text == "".join(out) + t[at:], t
    assert got[0].text == "[IP]" and overlaps


def test_pii_query(spark):
    names = ("email", "ip", "card", "phone")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries.op3_pii(spark, SF).collect():
        base = base_spans(texts[r.doc_id])
        assert [r[f"n_{k}"] for k in names] == [sum(s[1] == i for s in base) for i in range(4)]
        assert r.base_sha256 == sha(",".join(f"{names[k]}:{a}:{b}" for a, k, b in base))
        assert set(r.spans.split(",")) >= {f"{names[k]}:{a}:{b}" for a, k, b in base}


# --- 4 ---

def brute_components(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_embedding(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    out = []
    for i in range(400):
        v = base[i % 40] + rng.normal(size=16) * rng.choice([0, 0.02, 0.12, 0.16])
        out.append((i, [float(np.float32(x)) for x in v * rng.choice([1e-3, 1, 50])], int(i % 3 == 0)))
    out += [(500, None, 1), (501, [0.0] * 16, 1), (502, [float("nan")] * 16, 1), (503, [None] * 16, 1), (504, out[0][1], None), (505, out[0][1], 1), (506, [1.0], 1), (507, [], 1), (508, [1e30] * 16, 0), (509, [3e30] * 16, 0), (510, [2.0], 1)]
    df = spark.createDataFrame([(*r, 1, 2) for r in out], "vec_id long, embedding array<float>, label int, v int, grp int")
    links = set()
    good = [(i, np.array(v, float), y) for i, v, y in out if v and y is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    for i, u, y in good:
        for j, v, z in good:
            if i < j and y == z and len(u) == len(v) and (u / np.linalg.norm(u)) @ (v / np.linalg.norm(v)) >= 0.98:
                links.add((i, j))
    n = Counter(x for e in links for x in e)
    comp = brute_components([r[0] for r in out], links)
    for tile in (2048, 16):
        got = rows(embedding.find_near(df, tile=tile), "vec_id")
        assert len(got) == len(out)
        assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {i: (n[i], comp[i]) for i in comp}
    assert embedding.find_near(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)] + [(5, 5)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    want = brute_components({x for e in edges if e[0] != e[1] for x in e}, [e for e in edges if e[0] != e[1]])
    for most in (10**6, 0):
        assert {r.node: r.component for r in components.components(df, most).collect()} == want
    assert components.components(df.limit(0)).count() == 0


# --- 5 ---

def brute_words(corpus, size):
    first, out = {}, {}
    for i, t in sorted(corpus):
        w = ascii_words(t)
        gone = set()
        for a in range(len(w) - size + 1):
            key = tuple(w[a : a + size])
            if key in first:
                gone.update(range(a, a + size))
            else:
                first[key] = 1
        out[i] = (len(w), len(gone), sha(" ".join(x for a, x in enumerate(w) if a not in gone)))
    return out


def test_automaton():
    rng = random.Random(1)
    for _ in range(100):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(20))] for _ in range(3)]
        auto = automaton.Automaton()
        for t in texts[:2]:
            auto.add(t)
        subs = {tuple(t[i:j]) for t in texts[:2] for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
        want = [max([n for n in range(1, e + 2) if tuple(texts[2][e + 1 - n : e + 1]) in subs], default=0) for e in range(len(texts[2]))]
        assert auto.matches(texts[2]) == want


@pytest.mark.parametrize("most", [512, 1])
def test_substring(docs, corpus, most):
    got = rows(automaton.remove_repeats(docs, most=most), "doc_id")
    assert {i: (r.n_words, r.n_removed, sha(r.text)) for i, r in got.items()} == brute_words(corpus, 20)
    assert sum(r.n_removed for r in got.values()) > 1000
    assert automaton.remove_repeats(docs.limit(0)).count() == 0


def crowded():
    """One passage in very many contexts, copies, and rows that share a doc_id or have none."""
    rng = random.Random(8)
    passage = words(rng, 70)
    out = [(i, f"{words(rng, rng.randrange(4))} {passage} {words(rng, rng.randrange(6), 3)}") for i in range(150)]
    return out + [(i, out[i % 7][1]) for i in range(150, 200)]


@pytest.mark.parametrize("most", [512, 5])
def test_substring_crowded(spark, most):
    df = spark.createDataFrame(crowded(), "doc_id long, text string").repartition(4)
    got = rows(automaton.remove_repeats(df, most=most), "doc_id")
    assert {i: (r.n_words, r.n_removed, sha(r.text)) for i, r in got.items()} == brute_words(crowded(), 20)


def shared_ids(spark):
    """Rows with equal and null doc_ids, in one partition, and the same with ids of their own in that order."""
    rng = random.Random(10)
    a, b, c = (words(rng, 60) for _ in range(3))
    odd = [(3, a), (3, b + " " + a), (None, c), (1, a[:200]), (None, c + " x"), (3, a), (2, None), (None, None), (2, "y"), (5, c)]
    order = sorted(range(len(odd)), key=lambda i: (odd[i][0] is None, odd[i][0] or 0, i))
    return spark.createDataFrame(odd, "doc_id long, text string").coalesce(1), [(n, odd[i][1]) for n, i in enumerate(order)], [odd[i][0] for i in order]


def test_substring_shared_ids(spark):
    df, own, ids = shared_ids(spark)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, sha(r.text)) for r in automaton.remove_repeats(df).collect())
    assert got == sorted((str(ids[n]), *x) for n, x in brute_words(own, 20).items())


# --- 6 ---

def brute_near(corpus, size, num=80, den=100):
    sets = {}
    for i, t in corpus:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in ascii_words(t)]
        sets[i] = {tuple(w[a : a + size]) for a in range(max(1, len(w) - size + 1))} if w else set()
    ids = [i for i in sets if sets[i]]
    links = [(a, b) for a in ids for b in ids if a < b and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    comp = brute_components(sets, links)
    return {i: (len(s), comp[i]) for i, s in sets.items()}


@pytest.mark.parametrize("rules", [minhash.Rules(shingle=2), minhash.Rules(), minhash.Rules(shingle=2, tile=8, tile_items=1000)])
def test_minhash(docs, corpus, rules):
    got = rows(minhash.find_near(docs, rules), "doc_id")
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_near(corpus, rules.shingle)
    assert minhash.find_near(docs.limit(0), rules).count() == 0


def test_minhash_recall(spark):
    """Pairs just above and just below the threshold."""
    rng = random.Random(11)
    out = []
    for i in range(300):
        w = [f"d{i}x{j}" for j in range(101)]
        n = 10 if i % 2 else 13  # each replaced word loses two of 100 shingles: 91-10 ... of 100
        v = list(w)
        for j in rng.sample(range(2, 98, 4), n // 2):
            v[j] = "new" + str(rng.random())
        out += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    df = spark.createDataFrame(out, "doc_id long, text string")
    got = rows(minhash.find_near(df, minhash.Rules(shingle=2)), "doc_id")
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_near(out, 2)


def test_minhash_large_nodes(spark):
    """Rows that share a node are compared, however many share it with them."""
    rng = np.random.default_rng(12)
    sk = rng.integers(0, 1 << 16, (1000, minhash.COORDS), dtype=np.uint16)
    sk = np.where(rng.random(sk.shape) < 0.55, sk[0], sk)  # common values, for most pairs too few for a link
    for i in range(0, 1000, 2):
        j = rng.permutation(minhash.COORDS)[:30]
        sk[i + 1, j] = sk[i, j]
    rules = minhash.Rules(trees=3)
    reps = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in enumerate(sk)], "doc_id long, sketch binary")
    nodes = defaultdict(set)
    for r in minhash.paths(reps, rules).collect():
        nodes[r.node].add(r.doc_id)
    assert max(map(len, nodes.values())) > 256
    pairs = {(i, j) for x in nodes.values() for i in x for j in x if i < j}
    links = [(i, j) for i, j in pairs if (sk[i] == sk[j]).sum() >= rules.near * minhash.COORDS]
    got = [(r.u, r.v) for r in minhash.coarse_edges(reps, rules).collect()]
    assert brute_components(range(1000), got) == brute_components(range(1000), links)


# --- 7 ---

def test_bpe(spark, docs, corpus):
    path = queries.vocabulary("word_bpe_49k.json")
    tk = bpe.tokenizer(path)
    more = [(950, "It's <|startoftext|>A<|endoftext|> café  \x1c\x85x İΣς  1234 你好\U0001f600!?"), (951, "́a ẛ̣ I'LL they're'")]
    every = dict(corpus) | dict(more)
    df = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    for most in (600_000, 50):
        out = bpe.encode(df, path, most)
        got = rows(out, "doc_id")
        for i, t in every.items():
            ids = tk.encode(t or "", add_special_tokens=False).ids
            assert list(got[i].ids) == ids
            assert got[i].decoded == tk.decode(ids, skip_special_tokens=False)
        assert {r.doc_id: r.text for r in bpe.decode(out, path).collect()} == {i: r.decoded for i, r in got.items()}
    assert bpe.encode(df.limit(0), path).count() == 0


def test_bpe_query(spark):
    tk = bpe.tokenizer(queries.vocabulary("word_bpe_49k.json"))
    got = rows(queries.op7_bpe(spark, SF), "doc_id")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        ids = tk.encode(t, add_special_tokens=False).ids
        r = got[i]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(tk.decode(ids, skip_special_tokens=False)))


# --- 8 ---

def plain_words(t):
    return [w for w in (x.strip(toxicity.MARKS).lower() for x in ascii_words(t)) if w]


def brute_toxicity(texts, label, k):
    """A function (text, example to leave out) -> raw votes and nearest examples, all terms and pairs by hand."""
    ex = {i: y for i, y in label.items() if i in texts and zlib.crc32(str(i).encode()) % 3 != 1}
    df = Counter(w for t in texts.values() for w in set(plain_words(t)))
    n, pos, has, yes = len(ex), sum(ex.values()), Counter(), Counter()
    for i, y in ex.items():
        has.update(own := set(plain_words(texts[i])))
        yes.update(own if y else ())
    idf = {w: np.log((1 + len(texts)) / (1 + df[w])) + 1 for w in has}

    def phi(w):
        below = has[w] * (n - has[w]) * pos * (n - pos)
        return abs(n * yes[w] - has[w] * pos) / below**0.5 if below else 0.0

    gain = {w: idf[w] * (phi(w) + toxicity.FLOOR) for w in has}
    most = (np.log(1 + len(texts)) + 1) * toxicity.FLOOR

    def vector(t):
        v = {w: (1 + np.log(c)) * gain.get(w, most) for w, c in Counter(plain_words(t)).items()}
        norm = sum(x * x for x in v.values()) ** 0.5
        return {w: x / norm for w, x in v.items()}

    vectors = {i: vector(texts[i]) for i in ex}

    def votes(t, but=None):
        q = vector(t)
        cos = {i: sum(x * v.get(w, 0) for w, x in q.items()) for i, v in vectors.items() if i != but}
        last = sorted(cos.values(), reverse=True)[k - 1]
        near = {i: c for i, c in cos.items() if c >= last - 1e-12 and c > 0}
        share = {y: sum(c * c for i, c in near.items() if ex[i] == y) / sum(z == y for z in ex.values()) + 1e-6 for y in (0, 1)}
        return np.log(share[1] / share[0]), near

    return ex, votes


def test_toxicity_scores(spark):
    """Scores, votes and evidence against all cosines by hand; the decision; edge cases."""
    rng = random.Random(4)
    bad = ["idiot", "scum", "moron", "clown"]
    texts = {i: words(rng, 40) + " " + " ".join(rng.choice(bad) + "!" for _ in range(3 if i % 5 == 0 else 0)) + " " + " ".join(f"c{rng.randrange(6)}" for _ in range(0 if i % 5 == 0 else 4)) for i in range(400)}
    label = {i: int(i % 5 == 0) for i in texts}
    more = [(900, None), (901, ""), (902, "idiot scum"), (902, "idiot scum"), (903, "?! ..")]
    df = spark.createDataFrame([*texts.items(), *more], "doc_id long, text string").withColumn("toxic", F.lit("x"))
    lab = spark.createDataFrame([(i, None, y) for i, y in label.items()] + [(3, 1, None), (77777, 1, 1)], "doc_id long, quality int, toxic int")
    index = toxicity.fit(df, lab, size=8, k=9)
    every = texts | {900: "", 901: "", 902: "idiot scum", -902: "idiot scum", 903: "?! .."}
    ex, votes = brute_toxicity(every, label, 9)
    assert set(index.ids.tolist()) == set(ex) and len(ex) > 200
    raw = {i: votes(texts[i], i)[0] for i in ex}
    assert np.allclose(index.fit, toxicity.logistic(np.array([raw[i] for i in index.ids]), index.labels, weights_of(index.labels, (sum(ex.values()) + (zlib.crc32(b"77777") % 3 != 1)) / (len(ex) + (zlib.crc32(b"77777") % 3 != 1)))), atol=1e-6)
    got = toxicity.score(df, index).collect()
    by = {r.doc_id: r for r in got}
    for i, r in by.items():
        want, near = votes(every[i])
        assert np.isclose(r.score, 1 / (1 + np.exp(-(index.fit[0] * want + index.fit[1])))), i
        top = sorted(near.values(), reverse=True)[:3]
        assert np.allclose([e.similarity for e in r.evidence], top) and all(np.isclose(near[e.doc_id], e.similarity) and e.label == ex[e.doc_id] for e in r.evidence)
    assert len(got) == 405 and all((by[i].score >= 0.7) == (i % 5 == 0) for i in texts) and by[902].score >= 0.7 > by[900].score == by[901].score == by[903].score
    assert toxicity.drop_toxic(df, index).count() == 405 - 82
    assert len(toxicity.fit(df, lab, per_class=20).ids) == 40 and len(toxicity.fit(df, lab, class_bytes=1000).ids) < 20
    for none, low, high in ((lab.limit(0), 0.49, 0.51), (lab.filter("toxic = 0"), 0, 0.01), (lab.filter("toxic = 1"), 0.99, 1)):
        assert all(low <= r.score <= high for r in toxicity.score(df, toxicity.fit(df, none)).collect())
    assert toxicity.score(df.limit(0), index).count() == 0 and toxicity.fit(df.limit(0), lab).ids.tolist() == []


def weights_of(y, p):
    """Classes weighted as frequent as in all labels."""
    return np.where(y == 1, p / y.sum(), (1 - p) / (1 - y).sum()) * len(y)


def test_toxicity_query(spark):
    """The query's columns, and its quality on labels that it never saw."""
    folder = "/root/testdata/sf0.01"
    got = queries.op8_toxicity(spark, folder).collect()
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    s = [(r.score, label[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in label]
    yes, no = [x for x, y, _ in s if y], [x for x, y, _ in s if not y]
    assert sum((a > b) + (a == b) / 2 for a in yes for b in no) / len(yes) / len(no) > 0.93
    assert sum(y for _, y, p in s if p) / sum(p for *_, p in s) > 0.8 and sum((x - y) ** 2 for x, y, _ in s) / len(s) < 0.05


def test_toxicity_held_out(spark):
    """Held-out labels change nothing in the index."""
    rng = random.Random(6)
    df = spark.createDataFrame([(i, words(rng, 20) + (" scum scum" if i % 4 == 0 else " calm")) for i in range(200)], "doc_id long, text string")
    labels = [(i, int(i % 4 == 0)) for i in range(200)]
    held = {i for i, _ in labels if zlib.crc32(str(i).encode()) % 3 == 1}
    assert 0 < len(held) < 200
    a, b = [toxicity.fit(df, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, [(i, 1 - y if i in held else y) for i, y in labels])]
    assert not held & set(a.ids.tolist()) and a.ids.tolist() == b.ids.tolist() and a.fit == b.fit
    one, two = [sorted((r.doc_id, r.score) for r in toxicity.score(df, x).collect()) for x in (a, b)]
    assert one == two


# --- 9 ---

@pytest.mark.parametrize("bits", [256, 8])
def test_exact(spark, docs, corpus, bits):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in corpus}
    group = defaultdict(list)
    for i, t in norm.items():
        group[t].append(i)
    got = rows(exact.find_copies(docs, bits, memtable=5), "doc_id")
    assert {i: (r.keep_id, r.group_size) for i, r in got.items()} == {i: (min(group[t]), len(group[t])) for i, t in norm.items()}
    assert {r.doc_id for r in exact.drop_copies(docs).collect()} == {min(g) for g in group.values()}
    assert exact.drop_copies(docs).columns == docs.columns and exact.drop_copies(docs.limit(0)).count() == 0
    clash = docs.withColumns({"maybe": F.lit(1), "keep_of": F.lit(2), "KEEP_ID": F.lit(3), "__digest": F.lit(4)})
    assert exact.drop_copies(clash).columns == clash.columns and all(r[-4:] == (1, 2, 3, 4) for r in exact.drop_copies(clash).collect())
    assert exact.find_copies(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "z"), (None, "z"), (4, "q"), (None, "q"), (5, "r"), (5, "r")], "doc_id long, text string")
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in exact.find_copies(odd).collect()) == [("4", "4", 2), ("5", "5", 2), ("5", "5", 2), ("None", "4", 2), ("None", "None", 2), ("None", "None", 2)]
    assert sorted((str(r.doc_id), r.text) for r in exact.drop_copies(odd).collect()) == [("4", "q"), ("5", "r"), ("5", "r"), ("None", "z"), ("None", "z")]


def test_filters(spark, docs, monkeypatch):
    table = exact.runs(exact.digests(docs), memtable=16)
    own = defaultdict(list)
    for r in table.collect():
        own[r.run].append(bytes(r.digest))
    assert all(v == sorted(v) for v in own.values())
    other = [hashlib.sha256(str(i).encode()).digest() for i in range(1000)]
    for most in (exact.MOST_BITS, 1):
        f = exact.filter_of(table.select("digest").distinct(), most)
        assert f.may_hold([d for v in own.values() for d in v]).all() and f.may_hold(other).mean() < 0.1
    monkeypatch.setattr(exact, "SEGMENT", 512)
    many = spark.range(40_000).selectExpr("unhex(sha2(concat('n', id), 256)) AS digest")
    full = exact.filter_of(many, 1)  # far too small: it lets others pass, but holds none of its own off
    assert full.may_hold([bytes(r.digest) for r in many.limit(2000).collect()]).all() and 0.5 < full.may_hold(other).mean() < 1
    none = exact.filter_of(many.limit(0))
    assert not none.may_hold(other).any() and exact.may_repeat(spark, none) is not None


def test_levels(spark):
    """Runs of a level are sorted, each merges at most a few of the one before, and the last has one for each range."""
    rng = random.Random(31)
    rows_ = [(rng.choice([None, rng.randrange(10**6)]), hashlib.sha256(str(rng.randrange(3000)).encode()).digest()) for _ in range(8000)]
    rows_ += [(i, hashlib.sha256(b"hot").digest()) for i in range(4000)]
    found = spark.createDataFrame(rows_, "doc_id long, digest binary").repartition(6)
    flushed = exact.saved(exact.runs(found, memtable=64), "runs")
    assert exact.ranges(flushed) == exact.RANGES
    steps = list(exact.levels(flushed, 32, fan=4))
    sizes = [flushed.select("run").distinct().count()]
    assert len(steps) > 2
    for level in steps:
        own = defaultdict(list)
        for r in level.collect():
            own[r.shard, r.run].append(bytes(r.digest))
            assert r.digest[0] * 32 // 256 == r.shard
        assert all(x == sorted(set(x)) for x in own.values())
        sizes.append(len({run for _, run in own}))
        assert sizes[-1] <= -(-sizes[-2] // 4) + 1
    assert sizes[-1] == 1
    want = defaultdict(list)
    for d, k in rows_:
        want[k].append(d)
    index = exact.compacted(flushed, 32, fan=4)
    assert {bytes(r.digest): (r.keep_id, r.group_size) for r in index.collect()} == {k: (min((d for d in x if d is not None), default=None), len(x)) for k, x in want.items() if len(x) > 1}


def test_lookups_read_the_runs_they_must(spark):
    found = spark.range(20_000).selectExpr("id as doc_id", "unhex(sha2(cast(id div 2 as string), 256)) as digest")
    index = exact.compacted(exact.saved(exact.runs(found), "runs"), 64)
    folders = lambda df: {f.rpartition("/")[0].rpartition("=")[2] for f in df.inputFiles()}
    assert folders(index) == {str(i) for i in range(64)}
    asked = found.filter("doc_id in (3, 4000, 9001)")
    got = exact.looked_for(index, asked, 64)
    plan = got._jdf.queryExecution().executedPlan().toString()
    want = sorted({r.digest[0] * 64 // 256 for r in asked.collect()})
    assert "PartitionFilters: [shard" in plan and all(str(x) in plan.partition("PartitionFilters: [")[2].partition("]")[0] for x in want)
    keep = {bytes(r.digest): r.keep_id for r in got.collect()}
    assert {r.digest[0] * 64 // 256 for r in got.collect()} == set(want) and [keep[bytes(r.digest)] for r in asked.orderBy("doc_id").collect()] == [2, 4000, 9000]
    filters = exact.filter_of(index, shards_=64)
    assert (filters.size > 0).all() and filters.may_hold([bytes(r.digest) for r in found.limit(3000).collect()]).all()


# --- 10 ---

def brute_bytes(corpus, size):
    seen = Counter()
    for _, t in corpus:
        b = (t or "").encode()
        seen.update(b[i : i + size] for i in range(len(b) - size + 1))
    out = {}
    for d, t in corpus:
        b = (t or "").encode()
        mask = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if seen[b[i : i + size]] > 1:
                mask[i : i + size] = True
        runs = int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())
        out[d] = (len(b), int(mask.sum()), runs, sha(bytes(np.frombuffer(b, np.uint8)[~mask])))
    return out


def test_pipeline(spark):
    """Each stage on its own input against brute force, and the whole."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows_ = {r.doc_id: r for r in docs.collect()}
    index = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = {r.doc_id for r in toxicity.score(docs, index).collect() if r.score < 0.7}
    stages = dict(corpus_pipeline.STAGES)
    one = stages["toxicity"](spark, docs, SF)
    assert {r.doc_id for r in one.collect()} == clean and one.columns == docs.columns
    two = stages["exact dedup"](spark, docs, SF)
    first = {}
    for i in sorted(rows_):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows_[i].text), i)
    assert {r.doc_id for r in two.collect()} == set(first.values())
    three = stages["minhash near-dedup"](spark, docs, SF)
    near = brute_near([(i, r.text) for i, r in rows_.items()], 5)
    assert {r.doc_id for r in three.collect()} == {i for i, (_, c) in near.items() if i == c}
    four = stages["pii"](spark, docs, SF).collect()
    assert len(four) == len(rows_) and all(r.n_chars == len(r.text) for r in four)
    assert all((r.text == rows_[r.doc_id].text) == (not base_spans(rows_[r.doc_id].text)) or "[" in r.text for r in four)
    out = corpus_pipeline.run(spark, SF).collect()
    kept = {r.doc_id for r in out}
    assert kept <= clean & set(first.values()) and len(kept) > 50
    assert sum(r.length for r in out) == sum({r.doc_id: r.doc_tokens for r in out}.values())


def test_suffix_array():
    rng = random.Random(9)
    for _ in range(1500):
        s = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(30))]
        assert suffix.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    for _ in range(300):
        some = [[rng.randrange(1, rng.choice([2, 3, 5])) for _ in range(rng.randrange(30))] + [0] for _ in range(rng.randrange(1, 8))]
        start = np.concatenate([[0], np.cumsum([*map(len, some)])])
        want = [start[x] + i for x, r in enumerate(some) for i in sorted(range(len(r)), key=lambda i: r[i:])]
        flat = np.array(sum(some, []))
        assert suffix.suffix_arrays(flat, start).tolist() == want == suffix.sorted_suffixes(flat, start).tolist()


def test_suffix_repeated():
    rng = random.Random(13)
    for _ in range(200):
        shard, bodies, times = [], [], []
        for x in range(rng.randrange(1, 5)):
            for _ in range(rng.randrange(1, 4)):
                shard.append(x)
                bodies.append(bytes(rng.choice(b"ab") for _ in range(rng.randrange(8, 30))))
                times.append(rng.choice([1, 1, 2]))
        seen = Counter()
        for b, x, n in zip(bodies, shard, times):
            for i in range(len(b) - 9):
                seen[x, b[i : i + 10]] += n
        want = [(q, i) for q, (b, x) in enumerate(zip(bodies, shard)) for i in range(len(b) - 9) if seen[x, b[i : i + 10]] > 1]
        body, place = suffix.repeated(bodies, np.array(shard), np.array(times), 10)
        assert list(zip(body.tolist(), place.tolist())) == want


def test_suffix_shard():
    """Shards in which nothing repeats, a class that is alone, and ranges that lie apart."""
    rng = random.Random(14)
    a, b, c = (bytes(rng.randrange(97, 123) for _ in range(60)) for _ in range(3))

    def run(*classes):
        rows_ = [(f, b"%d" % i, i, 0, 0, 1, 0, n, body) for i, (f, n, body) in enumerate(classes)]
        got = [x for out in suffix.shard(iter([repeats.batch(rows_, repeats.CLASS)]), 20) for x in out.to_pylist()]
        return sorted((x["doc"], x["i"], x["e"]) for x in got)

    assert run((1, 1, a), (1, 1, b)) == [] and run((1, 1, a)) == [] and run((1, 2, a), (2, 1, b)) == [(0, 0, 60)]
    assert run((1, 1, a[:30] + b + a[30:]), (1, 1, a), (2, 1, c), (2, 3, c[5:50])) == [(0, 0, 30), (0, 90, 120), (1, 0, 60), (2, 5, 50), (3, 0, 45)]


def bytes_of(got):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in got}


@pytest.mark.parametrize("most", [64, 1])
def test_suffix(docs, corpus, most):
    assert bytes_of(suffix.remove_repeats(docs, most=most).collect()) == brute_bytes(corpus, 200)
    assert suffix.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("most", [64, 5])
def test_suffix_crowded(spark, most):
    df = spark.createDataFrame(crowded(), "doc_id long, text string").repartition(4)
    assert bytes_of(suffix.remove_repeats(df, most=most).collect()) == brute_bytes(crowded(), 200)


def test_suffix_shared_ids(spark):
    df, own, ids = shared_ids(spark)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in suffix.remove_repeats(df).collect())
    assert got == sorted((str(ids[n]), *x) for n, x in brute_bytes(own, 200).items())


def test_suffix_query(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op10_suffix_array_dedup(spark, SF).collect()}
    assert got == brute_bytes(texts, 200)
