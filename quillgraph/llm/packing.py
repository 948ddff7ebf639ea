"""Best-fit packing of tokenised texts into sequences of a fixed capacity.

Bounded-space online best fit: at most ``open_bins`` sequences stand open; a bitset has one bit for each
amount of free space that an open sequence has. A piece goes where it leaves the least space, found by one
shift and the lowest set bit; when it fits nowhere and all places are taken, the fullest open sequence closes.

Pieces are dealt out over independent packers of about ``UNIT`` pieces by a row number, never by a key of
the data, so no source or document makes one packer larger. Each packer takes its pieces from the longest
down. More data means more packers, never larger ones; each loses at most a part of one sequence.

Defined results: null and empty texts have one piece, the end id alone; only texts longer than the capacity
are cut, every piece but the last full; repeated rows and null doc_ids are packed like any others; ties go by
doc_id, piece and row. An empty table gives no rows. ``token_pieces`` reads doc_id and text alone; ``pack`` passes all
columns on, but for those named sequence_id or offset, in place of which its own come.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import stage
from quillgraph.llm.words import WordEncoder, packed, parts

#: Open bins bind: of 32,768 pieces of web-like lengths somewhat more would stand open at once.
CAPACITY, OPEN_BINS, UNIT, KEPT = 2048, 7168, 32768, 250_000


class BestFit:
    """Open bins by free space. ``place`` returns (bin, offset)."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.limit = capacity, open_bins
        self.bits, self.open, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        out = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return out

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + ((fits & -fits).bit_length() - 1)
            which = self._take(free)
        else:
            if self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, which = self.capacity, self.made
            self.made += 1
        rest = free - length
        if rest:
            self.by_free[rest].append(which)
            self.bits |= 1 << rest
            self.open += 1
        return which, self.capacity - free


@lru_cache(1)
def _words(path: str) -> WordEncoder:
    """Ids by the tokenizers library, which is given each word once."""
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    # words come normalised and split already
    tokenizer.normalizer = None
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    last = np.zeros(tokenizer.get_vocab_size(), bool)
    last[[i for token, i in model["vocab"].items() if token.endswith(model["end_of_word_suffix"])]] = True

    def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words go as one text of many, which is cut after the ids that end a word."""
        out, counts = [], []
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            own = np.diff(np.flatnonzero(last[ids]) + 1, prepend=0)
            if len(own) != len(part):  # a word that the library sees as two
                each = [e.ids for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                ids, own = np.array([i for x in each for i in x], np.uint32), np.array([len(x) for x in each])
            out.append(ids)
            counts.append(own)
        return np.concatenate(out), np.concatenate(counts)

    return WordEncoder(path, encode, KEPT)


def cut(counts: np.ndarray, going: bool, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row, place in the row, length) of pieces of rows with so many ids, and how many of the last row's, if it goes on, are left for later."""
    left = int(counts[-1] % capacity) if going else 0
    size = counts.copy()
    size[-1] -= left
    pieces = -(-size // capacity)
    row = np.repeat(np.arange(len(size)), pieces)
    place = np.arange(len(row)) - (np.cumsum(pieces) - pieces)[row]
    return row, place, np.minimum(capacity, size[row] - place * capacity), left


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids): each whole text's ids and the end id, cut at the capacity; ids packed in 32 bits.

    Long texts go in parts, whose full pieces leave at once, so a worker never holds the ids of a whole long text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        words = _words(path)
        for batch in batches:
            done, held, before = 0, np.empty(0, np.uint32), 0
            for texts, going in parts(batch.column(1)):
                ids, ends = words.encode(texts)
                if not going:  # every text is followed by the end id
                    ids, ends = np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)
                counts = np.diff(ends, prepend=0)
                if len(held):
                    ids, counts[0] = np.concatenate([held, ids]), counts[0] + len(held)
                row, place, length, left = cut(counts, going, capacity)
                at = place * capacity + np.where(row == 0, before, 0)
                ids, held = ids[: len(ids) - left], ids[len(ids) - left :]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(done + row)), pa.array(at // capacity, pa.int32()), pa.array(at), pa.array(length), packed(ids, np.cumsum(length)),
                ], ["doc_id", "piece", "start", "length", "ids"])
                pa.default_memory_pool().release_unused()
                before = before + int(counts[-1]) - left if going else 0
                if not going:
                    done += len(texts)

    return docs.selectExpr("doc_id", "cast(text as string) as text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start bigint, length bigint, ids binary")


def pack(pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """``pieces`` (any columns, with ``length`` from 1 to the capacity) and sequence_id long, offset long."""
    pieces = pieces.drop("sequence_id", "offset")
    row = "_row"
    while row in pieces.columns:
        row += "_"
    numbered = stage(pieces.withColumn(row, F.monotonically_increasing_id()), "pack_pieces")
    units = max(1, -(-numbered.count() // UNIT))
    order = [F.desc("length"), *(c for c in ("doc_id", "piece") if c in pieces.columns), row]
    dealt = numbered.repartition(units, F.xxhash64(row)).sortWithinPartitions(*order).drop(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 40
        for batch in batches:
            at = [fit.place(n) for n in batch.column(batch.schema.get_field_index("length")).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + b for b, _ in at], pa.int64()), pa.array([o for _, o in at], pa.int64())], [*batch.schema.names, "sequence_id", "offset"]
            )

    fields = [*dealt.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return dealt.mapInArrow(run, T.StructType(fields))
