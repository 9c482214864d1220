"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

fit() draws at most `per_class` labelled rows of each class, with at most `class_bytes` of text, by a hash of their
doc_id, as examples. Every word of theirs is a term. A term weighs

    (1 + log(its count in the text)) * idf * (relevance + FLOOR),

with idf from document frequencies over all documents, and relevance the correlation (phi) between a word and the label
among the examples; a word that no example has gets the greatest idf and no relevance, so it only lengthens the text's
vector. No word is left out, in products or in norms. The examples are indexed in blocks with the greatest weight of
each term in each block. Nearest examples are exact: only blocks whose bound stays below the `k`-th best are skipped.
Posting lists of very frequent terms are kept as rows and multiplied at once, which also tightens the bounds.

A score is the votes of the `k` nearest (all that tie for the last place count), weighted by the square of the cosine,
mapped to a probability by a logistic fit on the examples' own leave-one-out votes, with classes weighted as in all
labels that aren't held out. Nothing moves that probability afterwards.

The index is bounded by per_class and class_bytes; everything else covers all rows. Only texts enter a score.

Edge cases: null or empty texts, and texts without any term of the examples, get the score of texts without votes;
several labels of one document count as toxic if one does; of several texts of one labelled document the smallest is
the example; null labels don't count; with one class or none among the examples each score is the share of the class;
repeated rows are scored each; extra columns are ignored by score() and kept by drop_toxic(); an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns, pieces, released, word_ids

#: What is cut off from both ends of a word.
MARKS = ".,!?;:\"'()[]{}|*%&$#-_/\\<>«»„“”…"
SCORES = "doc_id long, score double, evidence array<struct<doc_id:long,label:int,similarity:double>>"
#: What a word counts that tells nothing about the label; texts compared at once; a posting list is long above this share;
#: bytes of text that a task counts at once.
FLOOR, TOGETHER, LONG, SLICE = 0.01, 16, 32, 1 << 19


def spread(first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges first[r] to first[r + 1] of rows: which of the rows, and each number in its range."""
    n = first[rows + 1] - first[rows]
    of = np.repeat(np.arange(len(rows)), n)
    return of, np.arange(len(of)) + np.repeat(first[rows] - np.cumsum(n) + n, n)


def hashed(words: pa.Array, seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in pc.cast(words, pa.binary()).to_pylist()), np.uint64, len(words))


@dataclass
class Words:
    """Words by number, as an Arrow array and its sorted hashes: a few bytes for each word, and nothing that Python counts."""

    words: pa.Array
    seed: int
    hashes: np.ndarray
    place: np.ndarray  # by hash: the word's number

    @classmethod
    def of(cls, words: pa.Array) -> Words:
        for seed in range(100):
            h = hashed(words, seed)
            place = np.argsort(h, kind="stable")
            if (np.diff(h[place]) != 0).all():  # no two words of one hash
                return cls(words, seed, h[place], place)
        raise ValueError("words repeat")

    def __len__(self) -> int:
        return len(self.words)

    def find(self, words: pa.Array) -> np.ndarray:
        """Numbers of words; those of words that aren't known, each its own, come after all known ones."""
        h = hashed(words, self.seed)
        out = np.full(len(words), -1)
        if len(self.words):
            at = self.place[np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)]
            same = pc.equal(self.words.take(pa.array(at)), words).to_numpy(zero_copy_only=False)
            out[same] = at[same]
        out[out < 0] = len(self.words) + np.unique(h[out < 0], return_inverse=True)[1]
        return out


@dataclass
class Index:
    """Labelled examples by term, in blocks of examples."""

    words: Words
    gain: np.ndarray  # by term: idf and relevance
    other: float  # the same for a word that no example has
    ids: np.ndarray
    labels: np.ndarray
    vote: np.ndarray  # what an example of each class counts
    start: np.ndarray  # by term: its first block entry; one more at the end
    block: np.ndarray  # by block entry: the block,
    most: np.ndarray  # the greatest weight of the term there,
    first: np.ndarray  # and its first posting; one more at the end
    example: np.ndarray  # by posting
    weight: np.ndarray
    size: int
    k: int
    fit: tuple[float, float]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "long"}

    @cached_property
    def long(self) -> tuple[np.ndarray, np.ndarray]:
        """Posting lists of terms that more than 1 / LONG of the examples have, as rows: each term's row or -1, and the rows."""
        place = np.full(len(self.gain), -1)
        begin = self.first[self.start]  # each term's postings lie one after the other
        often = np.flatnonzero(np.diff(begin) > len(self.ids) / LONG)
        place[often] = np.arange(len(often))
        lists = np.zeros((len(often), len(self.ids)))
        for row, i, j in zip(lists, begin[often], begin[often + 1]):
            row[self.example[i:j]] = self.weight[i:j]
        return place, lists

    def vectors(self, offsets: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Weights of the terms of texts of length one."""
        w = (1 + np.log(counts)) * np.append(self.gain, self.other)[np.minimum(terms, len(self.gain))]
        of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        return w / np.sqrt(np.maximum(np.bincount(of, w**2, len(offsets) - 1), 1e-300))[of]

    def cosines(self, of: np.ndarray, terms: np.ndarray, weights: np.ndarray, n: int, but: np.ndarray | None = None) -> np.ndarray:
        """(n, examples): cosines that are exact where they are among a text's k greatest, and at most those elsewhere.

        of: by term, its text. but: an example to leave out for each text.
        """
        known = terms < len(self.gain)
        of, terms, weights = of[known], terms[known], weights[known]
        examples = len(self.ids)
        if not examples:
            return np.zeros((n, 0))
        blocks = -(-examples // self.size)
        place, lists = self.long
        some = place[terms] >= 0
        texts = np.zeros((n, len(lists)))
        texts[of[some], place[terms[some]]] = weights[some]
        score = (texts @ lists).ravel()
        if but is not None:
            score[np.arange(n) * examples + but] = 0
        # what the short lists may add to a block, on top of the most that it has from the long ones
        at, entry = spread(self.start, terms[~some])
        of, w = of[~some][at], weights[~some][at]
        cell = of * blocks + self.block[entry]
        bound = np.bincount(cell, w * self.most[entry], n * blocks).reshape(n, blocks).astype(float)
        bound += np.maximum.reduceat(score.reshape(n, examples), np.arange(blocks) * self.size, axis=1)

        def add(these: np.ndarray) -> None:
            pick = np.flatnonzero(these.ravel()[cell])
            at, posting = spread(self.first, entry[pick])
            at = pick[at]
            score[:] += np.bincount(of[at] * examples + self.example[posting], w[at] * self.weight[posting], n * examples)
            if but is not None:
                score[np.arange(n) * examples + but] = 0

        seeds = np.zeros((n, blocks), bool)
        np.put_along_axis(seeds, np.argsort(-bound, axis=1, kind="stable")[:, : -(-self.k // self.size) + 1], True, 1)
        add(seeds)
        rest = ~seeds & (bound > 0)
        if examples > self.k:
            rest &= bound * (1 + 1e-9) >= np.partition(score.reshape(n, examples), -self.k, axis=1)[:, -self.k, None]
        add(rest)
        return score.reshape(n, examples)

    def nearest(self, score: np.ndarray) -> np.ndarray:
        """score with zeros but for the k greatest of each row and what ties with the last of them."""
        if score.shape[1] <= self.k:
            return score
        return np.where(score >= np.partition(score, -self.k, axis=1)[:, -self.k, None], score, 0)

    def raw(self, near: np.ndarray) -> np.ndarray:
        """Logit of the weighted share of toxic votes; a tiny vote for each class beforehand."""
        vote = near**2
        yes, no = (vote @ (self.labels == y) * self.vote[y] + 1e-6 for y in (1, 0))
        return np.log(yes / no)

    def probability(self, raw: np.ndarray) -> np.ndarray:
        a, b = self.fit
        return 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))

    def scored(self, text: pa.Array, evidence: int = 0) -> tuple[np.ndarray, list[list[dict]]]:
        """Scores of texts, and the nearest examples of each."""
        offsets, terms, counts = counted(text, self.words)
        weights = self.vectors(offsets, terms, counts)
        out, why = [], []
        for i in range(0, len(text), TOGETHER):
            j = min(i + TOGETHER, len(text))
            a, b = int(offsets[i]), int(offsets[j])
            near = self.nearest(self.cosines(np.repeat(np.arange(j - i), np.diff(offsets[i : j + 1])), terms[a:b], weights[a:b], j - i))
            out.append(self.probability(self.raw(near)))
            for row in near if evidence else ():
                some = np.flatnonzero(row)
                some = some[np.argsort(-row[some], kind="stable")[:evidence]]
                why.append([{"doc_id": int(self.ids[e]), "label": int(self.labels[e]), "similarity": float(row[e])} for e in some])
        return np.concatenate(out) if out else np.zeros(0), why or [[] for _ in range(len(text))]


def plain(words: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.utf8_trim(words, characters=MARKS))


def counted(text: pa.Array, known: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Offsets by text, and the terms of each with their counts; words that aren't known are numbered behind those."""
    offsets, index, words = word_ids(text)
    names = plain(words)
    code = np.where(pc.equal(names, "").to_numpy(zero_copy_only=False), -1, known.find(names))
    t = code[index] if len(index) else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keep, all_ = t >= 0, len(known) + len(names) + 1
    pair, count = np.unique(of[keep] * all_ + t[keep], return_counts=True)
    of, t = np.divmod(pair, all_)
    return np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(offsets) - 1))]).astype(np.int64), t, count


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return (F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 3 == 1)


def usable(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of labels that aren't held out."""
    known = columns(labels, "doc_id", "toxic").filter("doc_id is not null and toxic in (0, 1)")
    return known.filter(~F.coalesce(held_out(), F.lit(False))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def examples(docs: DataFrame, labels: DataFrame, per_class: int, class_bytes: int) -> DataFrame:
    """(doc_id, toxic, text): labelled documents of each class by a hash of doc_id, within both bounds."""
    known = usable(labels).join(columns(docs, "doc_id").distinct(), "doc_id", "left_semi")
    pick = [known.filter(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    # bounded by per_class, so it can go to every task, and no text moves but those picked
    rows = columns(docs, "doc_id", "text").join(F.broadcast(pick[0].union(pick[1])), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    by = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("bytes", F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(by)).filter(F.col("bytes") <= class_bytes).drop("bytes")


def relevance(of: np.ndarray, terms: np.ndarray, y: np.ndarray, n_terms: int) -> np.ndarray:
    """By term: the absolute correlation between its presence in an example and the example's label."""
    n, pos = len(y), y.sum()
    yes, df = np.bincount(terms, y[of], n_terms), np.bincount(terms, minlength=n_terms)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.nan_to_num(np.abs(n * yes - df * pos) / np.sqrt(df * (n - df) * (pos * (n - pos)).astype(float)))


def frequencies(docs: DataFrame, known: Words) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and the number of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(len(shared.value), np.int64), 0
        for b in pieces(batches, "text", SLICE):
            _, t, _ = counted(b.column(0), shared.value)
            df += np.bincount(t[t < len(df)], minlength=len(df))
            n += b.num_rows
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some.tolist()], pa.int64()), pa.array([n, *df[some].tolist()], pa.int64())], names=["term", "n"])

    # a row for each term of the examples, whose number is bounded with them
    rows = columns(docs, "text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, count_ = (rows.column(c).to_numpy() for c in ("term", "n"))
    df = np.zeros(len(known), np.int64)
    df[term[term >= 0]] = count_[term >= 0]
    return df, int(count_[term < 0].sum())


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic fit of y on x with a little shrinkage, by Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - y) * w * x).sum() + 1e-2 * (a - 1), ((p - y) * w).sum() + 1e-2 * b])
        s = w * p * (1 - p)
        h = np.array([[(s * x * x).sum() + 1e-2, (s * x).sum()], [(s * x).sum(), s.sum() + 1e-2]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, class_bytes: int = 16 << 20, k: int = 64, size: int = 256) -> Index:
    """An index of labelled examples."""
    rows = sorted(examples(docs, labels, per_class, class_bytes).collect(), key=lambda r: (r.toxic, r.doc_id))
    share = usable(labels).agg(F.avg("toxic").alias("p")).collect()[0].p
    p = share if share is not None else 0.5
    y = np.array([r.toxic for r in rows], np.int64)
    text, ids = pa.array([r.text for r in rows], pa.string()), np.array([r.doc_id for r in rows], np.int64)
    del rows
    parts = [text.slice(i, TOGETHER) for i in range(0, len(text), TOGETHER)]  # a few at a time, to bound the driver's memory
    names = [pc.unique(plain(word_ids(part)[2])) for part in parts]
    names = pc.unique(pa.concat_arrays(names)) if names else pa.array([], pa.string())
    known = Words.of(names.filter(pc.not_equal(names, "")))
    del names
    done = [counted(part, known) for part in parts]
    t, c = (np.concatenate([d[i] for d in done] or [np.zeros(0, np.int64)]) for i in (1, 2))
    offsets = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(d[0]) for d in done] or [np.zeros(0, np.int64)]))])
    del done, parts
    ex = np.repeat(np.arange(len(ids)), np.diff(offsets))
    df, n = frequencies(docs, known) if len(known) else (np.zeros(0, np.int64), 0)
    gain = (np.log((1 + n) / (1 + df)) + 1) * (relevance(ex, t, y, len(known)) + FLOOR)
    count = np.bincount(y, minlength=2)
    index = Index(known, gain, float((np.log(1 + n) + 1) * FLOOR), ids, y, 1 / np.maximum(1, count), *[np.zeros(0)] * 6, size, k, (1.0, 0.0))
    w = index.vectors(offsets, t, c)
    released()
    order = np.lexsort((ex, t))
    term, index.example, index.weight = t[order], ex[order].astype(np.int32), w[order]
    key = term * (len(ids) // size + 1) + index.example // size
    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    index.first, index.block = np.append(heads, len(key)).astype(np.int32), index.example[heads] // size
    index.most = np.maximum.reduceat(index.weight, heads) if len(heads) else np.zeros(0)
    index.start = np.searchsorted(term[heads], np.arange(len(known) + 1))
    if not count.all():  # nothing to tell apart: the share of the class
        index.vote = np.zeros(2)
        index.fit = (1.0, float(np.log((p + 1e-9) / (1 - p + 1e-9))))
        return index
    raw = []
    for i in range(0, len(ids), TOGETHER):
        j = min(i + TOGETHER, len(ids))
        a, b = int(offsets[i]), int(offsets[j])
        raw.append(index.raw(index.nearest(index.cosines(ex[a:b] - i, t[a:b], w[a:b], j - i, np.arange(i, j)))))
    index.fit = logistic(np.concatenate(raw), y, (np.array([1 - p, p]) / count)[y] * len(y))
    return index


def score(docs: DataFrame, index: Index, evidence: int = 3) -> DataFrame:
    """(doc_id, score, evidence): each whole text's score, and the nearest examples."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("similarity", pa.float64())]))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "text", SLICE):
            scores, why = shared.value.scored(b.column(1), evidence)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64()), pa.array(why, kind)], names=["doc_id", "score", "evidence"])

    return columns(docs, "doc_id", "text").mapInArrow(emit, SCORES)


def drop_toxic(docs: DataFrame, index: Index, cut: float = 0.7) -> DataFrame:
    """docs without those whose text scores `cut` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    # only texts go to Python, and only scores come back
    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for text in batches:
            parts = pieces(iter([pa.RecordBatch.from_arrays([text], names=["text"])]), "text", SLICE)
            done = [shared.value.scored(b.column(0))[0] for b in parts]
            yield pa.array(np.concatenate(done) if done else [], pa.float64())

    return docs.filter(scores(F.col("text")) < cut)
