"""Periodic runs, vector codes and language-model scores against brute force, with nulls, empty and long rows, ties and repeats."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import codes, lm, periodic, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, key string, n long, place string, others string, runs string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def docs_of(spark, texts):
    """Rows (doc_id, text) in three partitions, with columns named like those that operators make."""
    return spark.createDataFrame([(i, t, "k", 1, "p", "o", "r") for i, t in texts], DOCS).repartition(3)


# --- periodic runs --------------------------------------------------------------------------

def brute_runs(w):
    """(start, period, length) by trying each lag word by word."""
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q) and not any(all(w[k] == w[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                out.append((i, q, length))
            i = j + 1
    return sorted(out)


def repetitive(rng, n):
    w = []
    while len(w) < n:
        w += [rng.randrange(3) for _ in range(rng.randrange(1, 5))] * rng.randrange(1, 9) if rng.random() < 0.5 else [rng.randrange(4)]
    return w[:n]


@pytest.mark.parametrize("all_lags", [periodic.ALL_LAGS, 0])
def test_runs(monkeypatch, all_lags):
    monkeypatch.setattr(periodic, "ALL_LAGS", all_lags)
    rng = random.Random(3)
    for _ in range(600):
        w = repetitive(rng, rng.randrange(64))
        assert periodic.find_runs(np.array(w, np.int64)) == brute_runs(w), w


def test_runs_of_a_long_text():
    rng = random.Random(4)
    w = [rng.randrange(5000) for _ in range(60_000)]
    w[20_000:32_000] = w[20_000:23_000] * 4
    w[50_000:50_600] = [1, 2, 1, 3] * 150
    w[59_990:] = [7] * 10
    runs = periodic.find_runs(np.array(w, np.int64))
    assert {(20_000, 3000), (50_000, 4)} <= {(s, q) for s, q, _ in runs} and runs[-1][1] == 1
    at = {s: (q, n) for s, q, n in runs}
    assert at[20_000][1] >= 12_000 and at[50_000][1] >= 600


def test_find_periodic(spark):
    texts = [(1, "a b " * 5 + "c"), (2, None), (3, ""), (4, "x" * 100_000), (5, "\t a\n\x0ba  a a\ra a "), (5, "b"), (None, "é é é é é é"), (6, "a a a a")]
    got = {(r.doc_id, tuple((x.start, x.length, x.period) for x in r.runs), tuple(r.kept)) for r in periodic.find_periodic(docs_of(spark, texts)).collect()}
    assert got == {
        (1, ((0, 10, 2),), ("a", "b", "c")), (2, (), ()), (3, (), ()), (4, (), ("x" * 100_000,)), (5, ((0, 6, 1),), ("a",)), (5, (), ("b",)),
        (None, ((0, 6, 1),), ("é",)), (6, (), ("a a", "a a"))}
    assert periodic.find_periodic(docs_of(spark, texts).filter("doc_id > 9")).collect() == []


def test_op12_by_brute_force(spark):
    got = {r.doc_id: r for r in queries.op12_periodic_runs(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    some = 0
    for d, text in rows:
        w = WORD.findall(text or "")
        h, n = zlib.crc32(str(d).encode()), len(w)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 1200:  # the word-by-word search is cubic; such texts are among those of test_runs
            continue
        number = {x: i for i, x in enumerate(dict.fromkeys(w))}
        runs = brute_runs([number[x] for x in w])
        some += bool(runs)
        gone = {i for s, q, length in runs for i in range(s + q, s + length)}
        r = got[d]
        best = min(runs, key=lambda x: (-x[2], x[0], x[1]), default=None)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((best[0], best[2], best[1], 1000 * best[2] // best[1]) if best else (None,) * 4)
        assert (r.n_runs, r.runs_sha256) == (len(runs), sha("".join(f"{s},{length},{q}\n" for s, q, length in runs)))
        assert r.collapsed_sha256 == sha(" ".join(x for i, x in enumerate(w) if i not in gone))
    assert some > 5


# --- vector codes ---------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<double>, label int, code string, error string, x string, bound string"


def brute_codes(rows, parts, entries, rounds, scale):
    """Codes, errors and codebooks with every distance taken, in Python's integers."""
    whole = [(i, label, [math.floor(scale * c) for c in v]) for i, v, label in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(whole[0][2]) // parts
    cut = [[x[p * width : (p + 1) * width] for p in range(parts)] for _, _, x in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b))
    assign = lambda: [[min((far(x, e), k) for k, e in enumerate(books[p])) for p, x in enumerate(c)] for c in cut]
    for _ in range(rounds):
        now = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [c[p] for c, a in zip(cut, now) if a[p][1] == k]
                if own:
                    books[p][k] = [sum(x[j] for x in own) // len(own) for j in range(width)]
    last = assign()
    return [((i is None, i or 0), label, bytes(a[1] for a in r), sum(a[0] for a in r)) for (i, label, _), r in zip(whole, last)], books


@pytest.mark.parametrize("spread", [1.0, 0.02, 3e5])
def test_codes(spark, spread):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, spread) for _ in range(8)], rng.choice([0, 1, None])) for i in range(400)]
    rows += [(7, rows[7][1], 1), (400, rows[3][1], 0), (None, rows[5][1], 2), (401, None, 0), (402, [float("nan")] * 8, 0), (403, [None] + [1.0] * 7, 0), (404, [float("inf")] * 8, 0), (405, [0.0] * 8, 3), (406, [], 1)]
    table = spark.createDataFrame([(*r, "c", "e", "x", "b") for r in rows], VECTORS).repartition(3)
    coded, books = codes.encoded(table, parts=4, entries=24, rounds=2, scale=256)
    got = [((r.vec_id is None, r.vec_id or 0), r.label, bytes(r.code), r.error) for r in coded.collect()]
    expected, brute = brute_codes(rows, 4, 24, 2, 256)
    key = lambda r: (r[0], r[2], r[3], str(r[1]))
    assert sorted(got, key=key) == sorted(expected, key=key) and books.tolist() == brute
    sums = Counter()
    for _, label, _, e in expected:
        sums[label] += e
    assert {(r.label, r.label_error) for r in codes.label_errors(coded).collect()} == set(sums.items())
    assert codes.label_errors(coded).count() == len(expected)


def test_bounds_keep_most_distances_off():
    rng = np.random.default_rng(6)
    book = rng.integers(-90, 90, (64, 4))
    x = np.repeat(book, 200, axis=0) + rng.integers(-4, 5, (64 * 200, 4))
    group = codes.grouped(book)
    k = int(group.max()) + 1
    code, _, bound = codes.assign_all(x, book, group, k)
    new = book + rng.integers(-1, 2, book.shape)
    drift = np.array([np.sqrt(((new - book)[group == g] ** 2).sum(axis=1)).max(initial=0) for g in range(k)])
    again, d, held, taken = codes.assign_again(x, new, group, np.nextafter(drift.astype(np.float32), np.float32(np.inf)), code, bound)
    every = ((x[:, None] - new[None]) ** 2).sum(axis=2)
    assert (again == every.argmin(axis=1)).all() and (d == every.min(axis=1)).all()
    assert taken < 0.5 * every.size
    for g in range(k):  # bounds hold for all entries but the own one
        others = np.where((group == g) & (np.arange(64) != again[:, None]), every, 1 << 40).min(axis=1)
        assert (held[:, g].astype(float) ** 2 <= others).all()


def test_codes_of_few_rows_and_of_huge_numbers(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    coded, books = codes.encoded(empty)
    assert coded.collect() == [] and books.size == 0 and codes.label_errors(coded).collect() == []
    odd = spark.createDataFrame([(1, [1e30] * 16, 1), (2, [-1e30] * 16, 1), (3, [0.5] * 15, 1), (4, [0.5] * 32, 1)], "vec_id long, embedding array<double>, label int")
    coded, books = codes.encoded(odd)
    assert {(r.vec_id, bytes(r.code)[0], r.error) for r in coded.collect()} == {(1, 0, 0), (2, 1, 0)}
    assert books[0].tolist() == [[codes.MOST], [-codes.MOST]]
    far = spark.createDataFrame([(1, [1e10] * 16, 1), (2, [-1e10] * 16, 1), (3, [0.0] * 16, 1)], "vec_id long, embedding array<double>, label int")
    assert {(r.vec_id, r.error) for r in codes.encoded(far, entries=2)[0].collect()} == {(1, None), (2, 0), (3, None)}


# --- language-model scores ------------------------------------------------------------------

def small_texts():
    rng = random.Random(8)
    w = [f"W{i}" for i in range(60)] + ["z" * 40, "é" * 20]
    texts = [(i, " ".join(w[min(int(rng.expovariate(0.1)), 61)] for _ in range(rng.randrange(120)))) for i in range(60)]
    return texts + [(60, None), (61, ""), (62, "never seen words"), (62, "w1 W1\tw2"), (None, "W1 w2"), (63, "y" * 50_000), (64, "w3 " * 20_000)]


@pytest.fixture(scope="module")
def scored(spark):
    docs = docs_of(spark, small_texts()).select("doc_id", "text")
    model, counts = lm.fit(docs.filter(~lm.held_out()), head=20, outputs=12, width=8)
    return docs, model, lm.score(docs, model, counts).withColumn("held_out", lm.held_out()).collect()


def tokens_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w.encode() for w in WORD.findall(low)] + [b"\n"]


def test_lm_counts_and_base_scores(scored):
    _, model, got = scored
    c = Counter()
    for d, t in small_texts():
        if d is None or zlib.crc32(str(d).encode()) % 7 != 2:
            c.update(tokens_of(t))
    n, v = sum(c.values()), len(c)
    assert (model.tokens, model.types) == (n, v)
    expected = []
    for d, t in small_texts():
        w = tokens_of(t)
        base = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)
        expected.append((d if d is not None else -1, len(w), sum(c[x] > 0 for x in w), n, d is not None and zlib.crc32(str(d).encode()) % 7 == 2, round(base, 6)))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.train_tokens, r.held_out, round(r.base_score, 6)) for r in got) == sorted(expected)


def test_lm_scores_by_hand(scored):
    """Each token's probability from the model's rows, one at a time; all of them add up to one."""
    _, m, got = scored
    c = Counter()
    for d, t in small_texts():
        if d is None or zlib.crc32(str(d).encode()) % 7 != 2:
            c.update(tokens_of(t))
    own = {k: i for i, k in enumerate(m.head[: m.outputs])}
    rest = sum(n + 1 for k, n in c.items() if k not in own) + 1
    assert m.rest == rest

    def share(a, b):
        r = m.c[0].astype(float) * m.R[b] + m.c[1].astype(float) * m.R[a]
        s = np.exp(m.Q.astype(float) @ r + m.bias)
        return s / s.sum()

    by = {}
    for d, t in small_texts():
        a = b = 0
        total = 0.0
        for w in tokens_of(t):
            i = own.get(w, m.outputs)
            total += math.log10(share(a, b)[i]) + (math.log10((c[w] + 1) / rest) if i == m.outputs else 0)
            a, b = b, i
        by.setdefault(d, []).append(total)
    for r in got:
        assert any(abs(r.score - x) < 1e-3 + 1e-5 * abs(x) for x in by[r.doc_id]), (r, by[r.doc_id])
    p = share(3, 5)
    known = p[:-1].sum() + sum(p[-1] * (n + 1) / rest for k, n in c.items() if k not in own) + p[-1] / rest
    assert abs(known - 1) < 1e-9


def test_lm_gradients():
    """One minibatch's first step goes where the noise-contrastive objective, taken numerically, rises."""
    rng = np.random.default_rng(9)
    head = [lm.END, b"a", b"b", b"c"]
    R, Q = (rng.normal(0, 0.3, (5, 3)).astype(np.float32) for _ in "RQ")
    m = lm.Model(head, np.array([5, 9, 4, 2]), 22, 6, 4, R, Q, np.zeros(5, np.float32), np.ones((2, 3), np.float32))
    text = pa.array(["a b a a c d", "b b a"])
    changes = m.train(iter([text]), 1, 1e-4)
    noise_rng = np.random.default_rng(1)
    starts, _, own, _ = m.read(text)
    b, a = m.before(starts, own)
    noise_rng.permutation(len(np.unique(b * 5 + a)))
    share = m.shares
    noise = np.minimum(np.searchsorted(np.cumsum(share), noise_rng.random(lm.NOISE)), 4)

    def objective(R, Q, bias, c):
        r = c[0] * R[b] + c[1] * R[a]
        sigma = lambda s: 1 / (1 + np.exp(-s))
        yes = (r * Q[own]).sum(axis=1) + bias[own] - np.log(lm.NOISE * share[own])
        no = r @ Q[noise].T + bias[noise] - np.log(lm.NOISE * share[noise])
        return np.log(sigma(yes)).sum() + np.log(sigma(-no)).sum()

    start = [x.astype(float) for x in (m.R, m.Q, m.bias, m.c)]
    for which, row, col in [(0, 1, 0), (0, 0, 2), (1, 2, 1), (1, 4, 0), (2, 1, None), (3, 0, 1), (3, 1, 2)]:
        moved = [x.copy() for x in start]
        place = (row, col) if col is not None else row
        moved[which][place] += 1e-5
        slope = (objective(*moved) - objective(*start)) / 1e-5
        table = changes["RQQc"[which]][1]
        step = table[row, -1 if col is None else col]
        assert abs(step - 1e-4 * slope / math.sqrt(lm.START + slope**2)) < 2e-6, (which, row, col)


def test_lm_beats_single_tokens_on_unseen_texts(spark):
    out = queries.op11_lm_scoring(spark, "/root/testdata/sf0.01").agg(
        *[F.sum(F.when(F.col("held_out"), F.col(c))).alias(c) for c in ("score", "base_score", "n_tokens")]).collect()[0]
    assert (out.score - out.base_score) / out.n_tokens > 0.05


def test_lm_without_training_texts(spark):
    docs = docs_of(spark, [(1, "a b"), (2, None)])
    model, counts = lm.fit(docs.filter("doc_id > 5"))
    got = sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm.score(docs, model, counts).collect())
    assert got == [(1, 3, 0, 0, 0.0), (2, 1, 0, 0, 0.0)]
    assert lm.score(docs.filter("doc_id > 5"), model, counts).collect() == []
