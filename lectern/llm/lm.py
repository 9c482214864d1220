"""Language-model scores by a log-bilinear neural model, trained in numpy with noise-contrastive estimation.

Tokens are lower-cased words and an end for each text. All training tokens are counted in a table of the shared folder,
as large as the corpus makes it. The `outputs` most frequent tokens are the model's own; every other one is the
model's token REST. For the two tokens a, b before a token w,

    r = c1 * R[b] + c2 * R[a],    P(w | a, b) = exp(r . Q[w] + bias[w]) / sum over all tokens of the model,

and a token that REST stands for takes (count + 1) / (tokens + types + 1) of REST's share, counted over those tokens; all
words that training doesn't have share the + 1 of a type of their own. So the probabilities of all tokens add up to one.

Training: every task makes one pass over its whole share of the training texts, a slice at a time: minibatches of distinct
contexts with all tokens after them, each with its number, AdaGrad, and noise samples that a minibatch shares, drawn by
the tokens' frequencies; then each row's changes are averaged over the tasks,
weighted by how often a task touched it, by a Spark aggregate. Further rounds go on from there. Scoring multiplies a
slice's distinct contexts by all outputs at once, so each distribution is normalised over all of them.

The most frequent tokens, at most `head`, with their counts go to every task (64K keys of at most 32 bytes each). Counts of the
others, for scores and base scores, come from the table by a join on the key; none of them is frequent, so no key is hot.

A word is its own key if it has less than 32 bytes, otherwise its SHA-256.

Edge cases: null and empty texts are one end token; a null doc_id isn't held out; rows that share a doc_id are scored
each; without training texts base scores are 0, and every known token is REST's or the end; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns, pieces, released, saved, word_ids

#: The key of the end token; no word holds a line feed.
END = b"\n"
LONG = 32
#: Contexts in a minibatch, noise samples that it shares, step of AdaGrad and what its sums of squares start from.
BATCH, NOISE, STEP, START = 512, 128, 0.1, 0.1
#: Contexts multiplied at once.
CONTEXTS = 128
#: Bytes of text in a slice of training.
SLICE = 1 << 20


def keys(words: pa.Array) -> pa.Array:
    """The key of each word."""
    out = pc.cast(words, pa.binary())
    long = pc.greater_equal(pc.binary_length(out), LONG)
    if not pc.any(long).as_py():
        return out
    digests = pa.array([hashlib.sha256(w).digest() for w in out.filter(long).to_pylist()], pa.binary())
    return pc.replace_with_mask(out, long, digests)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


@dataclass
class Model:
    head: list[bytes]  # keys of the most frequent training tokens; END is the first
    count: np.ndarray  # how often each is there
    tokens: int
    types: int
    outputs: int  # tokens of the model's own; REST comes after them
    R: np.ndarray
    Q: np.ndarray
    bias: np.ndarray
    c: np.ndarray  # weights of the token before and the one before that

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "at"}

    @cached_property
    def at(self) -> dict[bytes, int]:
        return {k: i for i, k in enumerate(self.head)}

    @property
    def rest(self) -> int:
        """What the count + 1 of a token that REST stands for is divided by."""
        own = self.count[: self.outputs]
        return self.tokens - int(own.sum()) + self.types - int((own > 0).sum()) + 1

    @property
    def shares(self) -> np.ndarray:
        """How often each token of the model is there, plus one, as a share."""
        own = np.append(self.count[: self.outputs], self.tokens - self.count[: self.outputs].sum()) + 1.0
        return own / own.sum()

    def read(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Of texts, one after the other: where each one's tokens begin, the tokens as places in `head`, or -1 - the place
        in the keys of the words, the tokens as the model's, and the keys."""
        offsets, index, words = word_ids(text, lower=True)
        found = keys(words)
        place = np.fromiter((self.at.get(k, -1 - i) for i, k in enumerate(found.to_pylist())), np.int64, len(found))
        starts = offsets + np.arange(len(offsets))
        token = np.zeros(starts[-1], np.int64)
        word = np.ones(starts[-1], bool)
        word[starts[1:] - 1] = False
        token[word] = place[index] if len(index) else 0
        own = np.where((token < 0) | (token >= self.outputs), self.outputs, token)
        return starts, token, own, found

    def before(self, starts: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The token before each token, and the one before that; a text begins after ends."""
        b, a = np.zeros_like(own), np.zeros_like(own)
        b[1:], a[2:] = own[:-1], own[:-2]
        b[starts[:-1]] = a[starts[:-1]] = 0
        second = starts[:-1][np.diff(starts) > 1] + 1
        a[second] = 0
        return b, a

    def log_probabilities(self, starts: np.ndarray, own: np.ndarray) -> np.ndarray:
        """ln P of each token after the two before it."""
        b, a = self.before(starts, own)
        size = len(self.bias)
        pair, of = np.unique(b * size + a, return_inverse=True)
        order = np.argsort(of, kind="stable")
        ends = np.searchsorted(of[order], np.arange(0, len(pair) + CONTEXTS, CONTEXTS))
        outputs = np.ascontiguousarray(np.column_stack([self.Q, self.bias]).T)
        longest = np.sqrt((outputs**2).sum(axis=0).max())
        out = np.zeros(len(own))
        for i, j, k in zip(range(0, len(pair), CONTEXTS), ends, ends[1:]):
            x, y = np.divmod(pair[i : i + CONTEXTS], size)
            r = np.column_stack([self.c[0] * self.R[x] + self.c[1] * self.R[y], np.ones(len(x), np.float32)])
            s = r @ outputs
            these = order[j:k]
            # beyond what exp in single precision takes; a bound saves a look at all numbers
            if np.sqrt((r**2).sum(axis=1).max()) * longest > 60 and np.abs(s).max() > 60:
                s -= s.max(axis=1)[:, None]
            got = s[of[these] - i, own[these]].astype(np.float64)
            np.exp(s, out=s)
            out[these] = got - np.log(s.sum(axis=1).astype(np.float64))[of[these] - i]
        return out

    def train(self, texts: Iterator[pa.Array], seed: int, step: float) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """One pass over texts; how often each row of R, Q (with its bias) and c was touched, and how it changed."""
        rng = np.random.default_rng(seed)
        R, Q, c = self.R.copy(), np.column_stack([self.Q, self.bias]), self.c.copy()
        squares = [np.full(x.shape, START, np.float32) for x in (R, Q, c)]
        touched = [np.zeros(len(x), np.int64) for x in (R, Q, c)]
        share = self.shares
        sums, line = np.cumsum(share), np.log(NOISE * share).astype(np.float32)

        def change(which: int, x: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
            order = np.argsort(rows, kind="stable")
            at, first, n = np.unique(rows[order], return_index=True, return_counts=True)
            g = np.add.reduceat(gradient[order], first, axis=0)
            squares[which][at] += g * g
            x[at] += step * g / np.sqrt(squares[which][at])
            touched[which][at] += n

        for text in texts:
            starts, _, own, _ = self.read(text)
            b, a = self.before(starts, own)
            size = len(self.bias)
            context, of, times = np.unique(b * size + a, return_inverse=True, return_counts=True)
            shuffled = rng.permutation(len(context))  # the place of each context
            pair, n = np.unique(shuffled[of] * size + own, return_counts=True)
            of, w = np.divmod(pair, size)
            order = np.argsort(shuffled)
            context, times = context[order], times[order].astype(np.float32)
            ends = np.searchsorted(of, np.arange(0, len(context) + BATCH, BATCH))
            for i, j, k in zip(range(0, len(context), BATCH), ends, ends[1:]):
                x, y = np.divmod(context[i : i + BATCH], size)
                noise = np.minimum(np.searchsorted(sums, rng.random(NOISE)), len(sums) - 1)
                r = np.column_stack([c[0] * R[x] + c[1] * R[y], np.ones(len(x), np.float32)])
                at, word = of[j:k] - i, w[j:k]
                own_q, noise_q, own_r = Q[word], Q[noise], r[at]
                yes = n[j:k].astype(np.float32) / (1 + np.exp(np.clip(np.einsum("ij,ij->i", own_r, own_q) - line[word], -30, 30)))
                no = r @ noise_q.T
                no -= line[noise]
                np.exp(np.clip(no, -30, 30, out=no), out=no)
                no /= 1 + no
                no *= -times[i : i + BATCH, None]
                own_q *= yes[:, None]
                own_r *= yes[:, None]
                to_r = (np.add.reduceat(own_q, np.searchsorted(at, np.arange(len(x))), axis=0) + no @ noise_q)[:, :-1]
                change(1, Q, np.concatenate([word, noise]), np.concatenate([own_r, no.T @ r]))
                to_c = np.stack([(to_r * R[x]).sum(axis=0), (to_r * R[y]).sum(axis=0)])
                change(0, R, np.concatenate([x, y]), np.concatenate([to_r * c[0], to_r * c[1]]))
                change(2, c, np.arange(2), to_c)
        return {name: (t, new - old) for name, t, new, old in zip("RQc", touched, (R, Q, c), (self.R, np.column_stack([self.Q, self.bias]), self.c))}


def counted(docs: DataFrame) -> DataFrame:
    """(key, n): how often each token occurs in docs."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text"):
            _, index, words = word_ids(b.column(0), lower=True)
            n = np.bincount(index, minlength=len(words)) if len(index) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([keys(words), pa.array([END], pa.binary())]), pa.array([*n.tolist(), b.num_rows], pa.int64())], names=["key", "n"])

    return columns(docs, "text").mapInArrow(emit, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))


def trained(docs: DataFrame, model: Model, step: float) -> Model:
    """The model after one round over docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    width = model.R.shape[1] + 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        changes = shared.value.train((b.column(0) for b in pieces(batches, "text", SLICE)), TaskContext.get().partitionId(), step)
        for name, (n, x) in changes.items():
            some = np.flatnonzero(n)
            rows = np.zeros((len(some), width))
            rows[:, : x.shape[1]] = x[some] * n[some][:, None]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(n[some], pa.int64()), pa.array(list(rows), pa.list_(pa.float64()))], names=["table", "row", "n", "x"])
        released()

    rows = columns(docs, "text").mapInArrow(emit, "table string, row int, n long, x array<double>")
    sums = rows.groupBy("table", "row").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("x")[i]) for i in range(width)]).alias("x"))
    R, Q, c = model.R.copy(), np.column_stack([model.Q, model.bias]), model.c.copy()
    to = {"R": R, "Q": Q, "c": c}
    for r in sums.collect():  # at most the model's own rows
        x = to[r.table]
        x[r.row] += (np.array(r.x) / r.n)[: x.shape[1]].astype(np.float32)
    shared.destroy()
    return Model(model.head, model.count, model.tokens, model.types, model.outputs, R, np.ascontiguousarray(Q[:, :-1]), Q[:, -1].copy(), c)


def fit(docs: DataFrame, head: int = 1 << 16, outputs: int = 2048, width: int = 32, rounds: int = 1, step: float = STEP) -> tuple[Model, DataFrame]:
    """A model of the texts of docs, and the table (key, n) of all their tokens."""
    counts = saved(counted(docs), "tokens")
    tokens, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).collect()[0]
    # a cut by a histogram of counts, so that no task sends more than its share of the head
    place = F.floor(F.log2(F.col("n").cast("double")) * 64)
    cut, room = 1 << 20, head - 1
    for r in sorted(counts.groupBy(place.alias("place")).count().collect(), key=lambda r: -r.place):  # 64 for each doubling
        room -= r["count"]
        cut = r.place if room >= 0 else cut
    most = counts.filter((F.col("key") != F.lit(END)) & (place >= cut)).collect()
    most.sort(key=lambda r: (-r.n, bytes(r.key)))
    ends = tokens and counts.filter(F.col("key") == F.lit(END)).collect()[0].n
    known = [END, *(bytes(r.key) for r in most)]
    own = min(outputs, len(known))
    rng = np.random.default_rng(0)
    R, Q = (rng.normal(0, 0.1, (own + 1, width)).astype(np.float32) for _ in "RQ")
    model = Model(known, np.array([ends, *(r.n for r in most)], np.int64), tokens, types, own, R, Q, np.zeros(own + 1, np.float32), np.ones((2, width), np.float32))
    model.bias = np.log(model.shares).astype(np.float32)
    for _ in range(rounds if tokens else 0):
        model = trained(docs, model, step)
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score): log10 probabilities of whole texts; base_score is of single
    tokens by their counts plus one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest, base = float(np.log10(model.rest)), float(np.log10(model.tokens + model.types + 1))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        logs = np.log10(m.count + 1.0)
        for b in pieces(batches, "text", 2 << 20):
            starts, token, own, found = m.read(b.column(2))
            docs_ = len(starts) - 1
            of = np.repeat(np.arange(docs_), np.diff(starts))
            total = lambda x, where: np.bincount(of[where], x[where], docs_)
            some = token >= 0
            log_c = np.zeros(len(token))
            log_c[some] = logs[token[some]]
            known = some.copy()
            known[some] = m.count[token[some]] > 0
            others = own == m.outputs
            model_part = total(m.log_probabilities(starts, own) / np.log(10), slice(None)) + total(log_c - rest, others)
            # words that aren't in the head: each document's, with their numbers
            pair, n = np.unique(of[~some] * len(found) + (-1 - token[~some]), return_counts=True)
            doc, word = np.divmod(pair, max(1, len(found)))
            lists = pa.array(np.searchsorted(doc, np.arange(docs_ + 1)), pa.int32())
            items = pa.StructArray.from_arrays([found.take(pa.array(word)), pa.array(n, pa.int64())], names=["key", "n"])
            yield pa.RecordBatch.from_arrays([
                b.column(0), b.column(1), pa.array(np.diff(starts), pa.int64()), pa.array(np.bincount(of[known], minlength=docs_), pa.int64()),
                pa.array(total(log_c - base, slice(None)), pa.float64()), pa.array(model_part, pa.float64()), pa.ListArray.from_arrays(lists, items)],
                names=["place", "doc_id", "n_tokens", "n_known", "base_score", "score", "others"])

    rows = columns(docs, "doc_id", "text").select(F.monotonically_increasing_id().alias("place"), "doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    read = saved(rows.mapInArrow(emit, f"place long, doc_id {kind}, n_tokens long, n_known long, base_score double, score double, others array<struct<key:binary,n:long>>"), "scores")
    others = read.select("place", F.explode("others").alias("o")).select("place", "o.key", F.col("o.n").alias("times"))
    seen = others.join(counts, "key").groupBy("place").agg(F.sum("times").alias("times"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("logs"))
    out = read.drop("others").join(seen, "place", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return out.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("times", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + logs).alias("base_score"), (F.col("score") + logs).alias("score"))
