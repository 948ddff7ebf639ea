"""Token counts by byte-pair merging over a heap and a linked list, without any identifier.

A text is cut into pre-tokens; the bytes of one are its symbols. Adjacent pairs that the vocabulary merges lie in a
heap by rank, then place. The lowest is popped, its two symbols become one, and the list of neighbours closes over the
gap; the pairs at its sides enter the heap anew. What was pushed for symbols that have changed since is passed over
when popped. The count is the number of bytes less the number of merges: n log n for a pre-token of n bytes.

Segments of texts (a pre-token that begins with a space, and what follows up to the next) repeat, so each worker keeps
the counts of recent ones in two generations of ``KEPT`` and one step's at most; one that is gone is counted again with the
same result. Texts are cut into segments and those are numbered in Arrow. Long texts are walked match by match, so that
beside the text itself only one pre-token is held; a pre-token of n bytes takes some 60 n bytes while it is merged.

Defined results: null and empty texts have no bytes and no tokens; the strings of special tokens in a text count as one
token each, as the library has it by default; repeated rows and null ids count as they are; other columns, whatever
their names, are not read; an empty table gives no rows. Everything happens in the row of a document: nothing is shuffled.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.bpe import byte_symbols
from quillgraph.llm.common import slices, strings
from quillgraph.llm.words import SPACE, _unassigned

#: Segments kept a generation, the longest that is kept, characters from which on a text is walked, bytes of a step.
KEPT, LONG, WALKED, STEP = 700_000, 64, 1_000_000, 4_000_000
#: Marks where texts are cut; texts that hold it are counted uncut.
CUT = "\x00"


def _ranges(kind: str) -> str:
    """The code points of a class as ranges, for the engine of the standard library, which looks them up in tables."""
    points = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    return "".join(f"{re.escape(m[0][0])}-{re.escape(m[0][-1])}" for m in regex.finditer(rf"(?V1){kind}+", points))


@lru_cache(1)
def pre_tokens() -> re.Pattern:
    """The pattern of this kind of vocabulary, a fixed value, with letters, numbers and white space as the library has them."""
    newer = _unassigned()
    letter, number = (_ranges(rf"[\p{{{kind}}}--[{newer}]]" if newer else rf"\p{{{kind}}}") for kind in "LN")
    space = rf"{SPACE}\t-\r "
    # letters and numbers go first: no other part begins with either, or with a space before it
    return re.compile(rf" ?[{letter}]+| ?[{number}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class TokenCounter:
    """Counts tokens by a byte-level BPE file (.json)."""

    def __init__(self, path: str, kept: int = KEPT):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.symbol = [vocab[s] for s in byte_symbols()]
        #: Rank by the two ids of a pair, id by rank.
        self.rank: list[dict[int, int]] = [{} for _ in range(max(vocab.values()) + 1)]
        self.made: list[int] = []
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]):
            self.rank[vocab[a]].setdefault(vocab[b], rank)
            self.made.append(vocab[a + b])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pattern = pre_tokens()
        self.kept = kept
        #: Counts of recent segments in two generations.
        self.segments: dict[str, int] = {}
        self.former: dict[str, int] = {}

    def merged(self, data: bytes) -> int:
        """How many symbols are left of a pre-token's bytes."""
        count = len(data)
        if count < 2:
            return count
        rank, made, bits = self.rank, self.made, count.bit_length()
        mask = (1 << bits) - 1
        held = [self.symbol[b] for b in data]
        heap = [r << bits | i for i, (a, b) in enumerate(zip(held, held[1:])) if (r := rank[a].get(b)) is not None]
        if not heap:
            return count
        heapify(heap)
        after, before, left = list(range(1, count + 1)), list(range(-1, count - 1)), count
        if count > LONG:
            held, after, before = (array("q", x) for x in (held, after, before))
        while heap:
            key = heappop(heap)
            i = key & mask
            j, a = after[i], held[i]
            # a symbol that is gone is -1; of one that has grown no pair has the rank it was pushed with
            if j >= count or a < 0 or rank[a].get(held[j]) != key >> bits:
                continue
            a = held[i] = made[key >> bits]
            held[j] = -1
            left -= 1
            k = after[i] = after[j]
            if k < count:
                before[k] = i
                if (r := rank[a].get(held[k])) is not None:
                    heappush(heap, r << bits | i)
            h = before[i]
            if h >= 0 and (r := rank[held[h]].get(a)) is not None:
                heappush(heap, r << bits | h)
        return left

    def _plain(self, text: str) -> int:
        """Tokens of a text without special ones."""
        merged = self.merged
        if len(text) > WALKED:
            return sum(merged(m[0].encode("utf-8")) for m in self.pattern.finditer(text))
        return sum([merged(t.encode("utf-8")) for t in self.pattern.findall(text)])

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        n, at = 0, 0
        for m in self.special.finditer(text):
            n += 1 + self._plain(text[at : m.start()])
            at = m.end()
        return n + self._plain(text[at:])


    def count_all(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text of a column (wide strings without nulls).

        A pre-token that begins with a space begins before it, and the space is followed by something else than white
        space; so texts are cut there, in Arrow, without a change to their pre-tokens. Distinct segments are numbered
        and counted once each; special strings hold no space, so none is cut.
        """
        if pc.any(pc.match_substring(column, CUT)).as_py() or pc.max(pc.binary_length(column)).as_py() > WALKED:
            return np.array([self.count(t.as_py()) for t in column], np.int64)
        # a space before white space, or at the end, is no cut; without such ones every space is
        blank = f"[{SPACE}\t-\r ]"
        odd = pc.match_substring_regex(column, f" (?:{blank}|\\z)")
        cut = pc.replace_substring(column, " ", CUT + " ")
        if pc.any(odd).as_py():
            cut = pc.if_else(odd, pc.replace_substring_regex(column, f" ([^{blank[1:-1]}])", CUT + r" \1"), cut)
        split = pc.split_pattern(cut, CUT)
        numbered = split.flatten().dictionary_encode()
        known, counts = self.segments, np.empty(len(numbered.dictionary), np.int64)
        if len(known) > self.kept:
            self.former, self.segments = known, {}
            known = self.segments
        former = self.former
        for i, segment in enumerate(numbered.dictionary.to_pylist()):
            n = known.get(segment)
            if n is None:
                n = former.get(segment)
                if n is None:
                    core = segment[1:] if segment[:1] == " " else segment
                    # letters alone are one pre-token; beyond U+0500 the library's tables decide what is a letter
                    n = self.merged(segment.encode("utf-8")) if core.isalpha() and max(core) < "\u0500" else self.count(segment)
                if len(segment) <= LONG:
                    known[segment] = n
            counts[i] = n
        return np.add.reduceat(counts[numbered.indices.to_numpy()], split.offsets.to_numpy()[:-1]) if len(column) else counts


@lru_cache(2)
def counter(path: str) -> TokenCounter:
    """The counter of a file; each worker loads it once."""
    return TokenCounter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for whole in batches:
            for batch in slices(whole, "text", STEP):
                column = strings(batch.column(1))
                counts = pa.array(tokens.count_all(column))
                yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_length(column).cast(pa.int64()), counts], ["doc_id", "n_bytes", "n_tokens"])

    counted = docs.selectExpr("doc_id", "cast(text as string) as text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
