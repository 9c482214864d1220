"""BPE encoding and decoding through tables of distinct words.

A task splits the texts of a block at ASCII white space, encodes each distinct word once, and joins the ids back by
position; decoding joins ids to their pieces. A word's ids don't depend on its neighbours, as the tokenizer splits at
white space anyway and drops it, so this gives what encoding the whole text gives.

The word table lives as long as its task, up to `table_words` words. One table of the corpus was built and measured: it
grows with the corpus (1.5 million words in 0.1 GB), so it can't be broadcast, and each block's distinct words have to
move three times, to be grouped, joined and laid out by position. Encoding a word again in another task moves nothing.

Edge cases: null text counts as empty, which has no ids and decodes to an empty text; strings of special tokens become
their ids, as in the library; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import columns, pieces, word_ids

IDS = "doc_id long, ids array<int>, decoded string"


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


class WordTable:
    """Ids of distinct words, encoded when first met."""

    def __init__(self, path: str, most: int) -> None:
        self.tokenizer, self.most = tokenizer(path), most
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.start, self.count, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def rows(self, words: list[str]) -> np.ndarray:
        """The row of each word; new ones are encoded."""
        if len(self.row) + len(words) > self.most:
            self.clear()
        row = self.row
        new = [w for w in words if w not in row]
        if new:
            encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
            ids = [e.ids for i in range(0, len(new), 20_000) for e in encode(new[i : i + 20_000], add_special_tokens=False)]
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((x for i in ids for x in i), np.int32, int(count.sum()))
            at = len(row)
            row.update(zip(new, range(at, at + len(new))))
            self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.ids = np.concatenate([self.ids, flat])
        return np.fromiter((row[w] for w in words), np.int64, len(words))


def encoder(path: str, table_words: int = 600_000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[pa.Array, pa.ListArray, pa.Array]]]:
    """A function from batches (doc_id, text) to doc_id, ids and decoded texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.ListArray, pa.Array]]:
        table = WordTable(path, table_words)
        vocab = table.tokenizer.get_vocab(with_added_tokens=True)
        names: list[str | None] = [None] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            names[i] = piece
        id_to_piece = pa.array(names, pa.string())
        for b in pieces(batches, "text", 16 << 20):
            offsets, index, words = word_ids(b.column(1))
            rows = table.rows(words.to_pylist())[index]
            count = table.count[rows]
            ends = np.concatenate([[0], np.cumsum(count)])
            # the place of each id in the table: its word's first one, plus its number within the word
            flat = table.ids[np.repeat(table.start[rows] - ends[:-1], count) + np.arange(ends[-1])]
            at = pa.array(ends[offsets].astype(np.int32))
            decoded = pc.binary_join(pa.ListArray.from_arrays(at, id_to_piece.take(pa.array(flat))), " ")
            yield b.column(0), pa.ListArray.from_arrays(at, pa.array(flat)), decoded

    return run


def encode(docs: DataFrame, path: str, table_words: int = 600_000) -> DataFrame:
    """(doc_id, ids, decoded): each whole text encoded as the tokenizers library does, and the ids decoded again."""
    run = encoder(path, table_words)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(batches):
            yield pa.RecordBatch.from_arrays(list(out), names=["doc_id", "ids", "decoded"])

    return columns(docs, "doc_id", "text").mapInArrow(emit, IDS)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text): ids joined to their pieces by position, pieces joined by a space; special tokens stay."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = tokenizer(path).get_vocab(with_added_tokens=True)
        table = pa.array([k for k, _ in sorted(vocab.items(), key=lambda x: x[1])], pa.string())
        for b in batches:
            ids = b.column("ids")
            flat = table.take(ids.flatten())
            at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pc.binary_join(pa.ListArray.from_arrays(pa.array(at), flat), " ")], names=["doc_id", "text"])

    return columns(encoded, "doc_id", "ids").mapInArrow(emit, "doc_id long, text string")
