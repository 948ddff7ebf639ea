"""Exact BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a word there is exactly one token that can end its encoding: a token that is a suffix
of the prefix and compatible with the last token of what stands before it. An automaton over the vocabulary
(suffix links included) lists the tokens that end at each position; two tokens are compatible when no merge
across their border would come before the merges that build them. The unique last token of each prefix is
stored, and back-pointers from the end of the word emit the ids. No merge loop runs over the text.

Words repeat, so each worker keeps the ids of recent words in bounded tables (see ``words``).

Defined results: null and empty texts have no ids and decode to the empty string; texts of any length are
encoded whole; the strings of special tokens in a text become those tokens, as the tokenizers library has it
by default; null ids decode to null. Repeated rows, null doc_ids and further columns are passed over unchanged or unread.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quillgraph.llm.common import slices
from quillgraph.llm.words import WordEncoder, packed, parts

#: Bytes of texts, or of ids, that one step works on.
END, PAIRS_KEPT, STEP = "\ue000", 300_000, 2_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable in Latin-1, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b if b in plain else 0x100 + extra))
        extra += b not in plain
    return out


class Vocabulary:
    """A tokenizer file of the kind ``word_bpe``: NFC, lower case, words with ends, byte symbols, merges by rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.never = 4 * len(self.vocab)
        self.merge_rank: dict[int, dict[int, int]] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.born: dict[int, int] = {}
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            left, right, whole = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.merge_rank.setdefault(left, {})[right] = rank
            if whole in self.parts:
                raise ValueError(f"two merges build {a + b!r}; its history is not unique")
            self.parts[whole], self.born[whole] = (left, right), rank
        self.automaton = ahocorasick.Automaton()
        for token, i in self.vocab.items():
            shown = token.removesuffix(self.suffix) + END if token.endswith(self.suffix) and token != self.suffix else token
            self.automaton.add_word(shown, (i, len(shown)))
        self.automaton.make_automaton()
        self.symbols = byte_symbols()
        self._compatible: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self._left_edge: dict[int, list[tuple[int, int, int]]] = {}
        self._right_edge: dict[int, list[tuple[int, int, int]]] = {}
        self.texts = WordEncoder(path, self.words_ids)

    def edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """(token, rank that made it, rank that used it up) of the pieces that once lay at one edge of ``token``."""
        kept = (self._left_edge, self._right_edge)[side]
        if token not in kept:
            out, used = [], self.never
            piece = token
            while True:
                made = self.born.get(piece, -1)
                out.append((piece, made, used))
                if piece not in self.parts:
                    break
                used, piece = made, self.parts[piece][side]
            kept[token] = out
        return kept[token]

    def clash(self, left: int, right: int, until: int) -> bool:
        """Whether a merge across the border of two tokens comes first, before the rank ``until``."""
        edge = self.edge(right, 0)
        for x, x_made, x_used in self.edge(left, 1):
            after = self.merge_rank.get(x)
            if after is None:
                continue
            for y, y_made, y_used in edge:
                rank = after.get(y)
                # of equal ranks the leftmost goes first
                if rank is not None and rank < until and rank < x_used and rank <= y_used and y_made < x_used and x_made <= y_used:
                    return True
        return False

    def whole(self, token: int) -> bool:
        """Whether the encoding of a token's own text is that token."""
        if token not in self._whole:
            if token in self.parts:
                a, b = self.parts[token]
                self._whole[token] = self.whole(a) and self.whole(b) and not self.clash(a, b, self.born[token])
            else:
                self._whole[token] = True
        return self._whole[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether two tokens can stand side by side in an encoding."""
        pair = left << 20 | right
        known = self._compatible.get(pair)
        if known is None:
            if len(self._compatible) > PAIRS_KEPT:
                self._compatible.clear()
            known = self._compatible[pair] = not self.clash(left, right, self.never)
        return known

    def word_ids(self, word: str) -> list[int]:
        """The ids of one pre-token, given as text."""
        shown = "".join([self.symbols[b] for b in word.encode("utf-8")]) + END
        n = len(shown)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        known = self._compatible
        for end, (token, length) in self.automaton.iter(shown):
            i = end + 1
            if last[i] >= 0:
                continue
            j = i - length
            before = last[j]
            if j and before < 0:
                continue
            ok = known.get(before << 20 | token) if j else True
            if ok is None:
                ok = self.compatible(before, token)
            if ok and self.whole(token):
                last[i], size[i] = token, length
        out, i = [], n
        while i:
            out.append(last[i])
            i -= size[i]
        return out[::-1]

    def words_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of pre-tokens end to end, how many each has)."""
        ids = [self.word_ids(w) for w in words]
        return np.fromiter(chain.from_iterable(ids), np.uint32), np.array([len(x) for x in ids], np.int64)

    def encode(self, texts: pa.Array) -> pa.Array:
        """The ids of each text as little-endian unsigned 32-bit integers; a long text goes in parts."""
        out, ends, begun = [], [], 0
        for part, going in parts(texts):
            ids, stops = self.texts.encode(part)
            out.append(ids)
            ends.append(stops[: len(stops) - going] + begun)
            begun += len(ids)
        return packed(np.concatenate(out), np.concatenate(ends)) if out else pa.array([], pa.binary())


@lru_cache(2)
def token_list(path: str) -> list[str]:
    """The tokens of a file by id, special ones included; all that decoding needs."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ids = {**spec["model"]["vocab"], **{t["content"]: t["id"] for t in spec["added_tokens"]}}
    out = [""] * (max(ids.values()) + 1)
    for token, i in ids.items():
        out[i] = token
    return out


def decode(ids: pa.Array, tokens: pa.Array) -> pa.Array:
    """Each row's tokens joined by spaces; null for null."""
    size = pc.fill_null(pc.binary_length(ids), 0).to_numpy(zero_copy_only=False) // 4
    flat = np.frombuffer(b"".join(x.as_buffer() for x in ids if x.is_valid), "<u4")
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), tokens.take(pa.array(flat)))
    joined = pc.binary_join(lists, pa.scalar(" ", tokens.type)).cast(pa.string())
    return pc.if_else(ids.is_valid(), joined, pa.scalar(None, pa.string())) if ids.null_count else joined


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file; each worker loads it once."""
    return Vocabulary(path)


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the ids of each whole text, packed as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path)
        for whole in batches:
            for batch in slices(whole, "text", STEP):
                yield pa.RecordBatch.from_arrays([batch.column(0), vocab.encode(batch.column(1))], ["doc_id", "ids"])
                pa.default_memory_pool().release_unused()

    return docs.selectExpr("doc_id", "cast(text as string) as text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): tokens joined by spaces, as a tokenizer without a decoder has it, special tokens kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(token_list(path), pa.large_string())
        for whole in batches:
            for batch in slices(whole, "ids", STEP):
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), decode(batch.column(1), tokens)], ["doc_id", "ids", "decoded"])
                pa.default_memory_pool().release_unused()

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids binary, decoded string")
