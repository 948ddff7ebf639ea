"""Grouping of spelling variants by minimal acyclic automata in both directions.

Words that differ by one inserted, deleted or replaced letter share one half of the asked word exactly: its first
letters if the difference stands in the second half, else its last ones. So a forward automaton is followed through the
first half exactly and completes the rest with one error; a backward one, built of reversed words, does the same from
the end. A pair that both would find is left to the forward one. Every state holds how many words begin before its
letters (perfect hashing), so a path ends with the word's number, which leads to its text and count.

The words are dealt into blocks of about ``BLOCK`` by ranges of their order, once as they are and once reversed. Words
that share a prefix stand together in the first, those that share a suffix in the second, so a word asks only the blocks
whose range can hold its exact half: one or two, nearly always. Where very many words share a half, the place where the
word is cut moves to where the fewest blocks have to be asked. Each block is one task's work: its automaton is built
from sorted words, then the asking words stream by. A task hands on one row for each asking word, never pairs.

Occurrences are counted within tasks before they are shuffled; the boundaries of blocks come from a bounded sample of
some ``SAMPLE`` words a block, which decides where work is done and no result. Roots are found by pointer jumping: since a
form has twice the count of its variant, chains are no longer than the logarithm of the largest count.

Defined results: null and empty texts have no words, and an empty table gives no rows; texts of any length are read
whole; repeated rows count again; a null doc_id is told as the empty text before the colon; of forms with equal counts the
first in code-point order holds; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import discard, slices, stage, strings

#: Letters and runs that are words, fewest code points and occurrences, how many runs in how many lose a letter.
LETTERS, SHORTEST, FEWEST, ODD = r"[A-Za-zÀ-ÿ]+", 5, 3, 97
BLOCK, SAMPLE, HELD, STEP, WALKED, MOST_BLOCKS = 20_000, 64, 200_000, 4_000_000, 1_000_000, 8192
LAST = "\U0010ffff"


def told_word(doc_id: str, run: str, odd: int = ODD) -> str:
    """The run as its document tells it: one in ``odd`` runs lacks a letter, by the digest of document and run."""
    h = crc32(f"{doc_id}:{run}".encode())
    if h % odd:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST) -> DataFrame:
    """(word, n) of the words with at least so many code points and occurrences in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, held = re.compile(LETTERS), {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for whole in batches:
            for batch in slices(whole, "text", STEP):
                ids, low = batch.column(0).to_pylist(), pc.ascii_lower(strings(batch.column(1)))
                for doc_id, text in zip(ids, low):
                    own: dict[str, int] = {}
                    whole_text = text.as_py()
                    for w in letters.findall(whole_text) if len(whole_text) < WALKED else (m[0] for m in letters.finditer(whole_text)):
                        own[w] = own.get(w, 0) + 1
                    told = "" if doc_id is None else doc_id
                    for w, n in own.items():
                        # a run of the least length may lose a letter, so shorter ones than that never count
                        if len(w) >= shortest and len(w := told_word(told, w)) >= shortest:
                            held[w] = held.get(w, 0) + n
                    if len(held) > HELD:
                        yield out()
                        held.clear()
        if held:
            yield out()

    counted = docs.selectExpr("cast(doc_id as string) as doc_id", "cast(text as string) as text").mapInArrow(run, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


class Automaton:
    """A minimal acyclic automaton of sorted distinct words; the number of a word is its place among them."""

    def __init__(self, words: list[str]):
        #: Of each state: letter to (next state, words before it), whether a word ends here, how many do from here on.
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.count: list[int] = []
        known: dict[tuple, int] = {}
        # the path of the last word, not yet made minimal: (letters to finished states, ends)
        path: list[list] = [[{}, False]]
        last = ""

        def close(node: list) -> int:
            key = (node[1], tuple(node[0].items()))
            state = known.get(key)
            if state is None:
                state = known[key] = len(self.edges)
                n, edges = int(node[1]), {}
                for letter, to in node[0].items():
                    edges[letter] = (to, n)
                    n += self.count[to]
                self.edges.append(edges)
                self.final.append(node[1])
                self.count.append(n)
            return state

        for word in chain(words, [None]):
            same = 0
            if word is not None:
                limit = min(len(word), len(last))
                while same < limit and word[same] == last[same]:
                    same += 1
            while len(path) > same + 1:
                node = path.pop()
                path[-1][0][last[len(path) - 1]] = close(node)
            if word is None:
                break
            for _ in word[same:]:
                path.append([{}, False])
            path[-1][1] = True
            last = word
        self.root = close(path[0])

    def walk(self, state: int, number: int, letters: str) -> tuple[int, int]:
        """(state, words before) after the letters; state -1 where there is no such path."""
        edges = self.edges
        for letter in letters:
            step = edges[state].get(letter)
            if step is None:
                return -1, 0
            state, number = step[0], number + step[1]
        return state, number

    def near(self, word: str, exact: int) -> set[int]:
        """Numbers of the words that share the first ``exact`` letters and differ by one error after them."""
        state, number = self.walk(self.root, 0, word[:exact])
        found: set[int] = set()
        edges, final, walk = self.edges, self.final, self.walk
        at, n = exact, len(word)
        while state >= 0:
            here = word[at] if at < n else ""
            rest = word[at + 1 :]
            if here:
                to, k = walk(state, number, rest)  # the letter is left out
                if to >= 0 and final[to]:
                    found.add(k)
            for letter, (to, before) in edges[state].items():
                if letter != here:
                    if here:
                        end, k = walk(to, number + before, rest)  # another letter in its place
                        if end >= 0 and final[end]:
                            found.add(k)
                    end, k = walk(to, number + before, word[at:])  # one letter more
                    if end >= 0 and final[end]:
                        found.add(k)
            step = edges[state].get(here) if here else None
            if step is None:
                break
            # one more letter equal to the present one is found at its later end
            state, number, at = step[0], number + step[1], at + 1
        return found


def boundaries(words: DataFrame, total: int, n_blocks: int) -> tuple[list[str], list[str]]:
    """First words of blocks in order, forward and reversed, from a sample by hash of about ``SAMPLE`` words a block."""
    if n_blocks < 2:
        return [], []
    sample = [r.word for r in words.where(F.pmod(F.xxhash64("word"), F.lit(max(1, total // (SAMPLE * n_blocks)))) == 0).select("word").collect()]
    if not sample:
        return [], []
    cut = lambda xs: sorted({xs[len(xs) * i // n_blocks] for i in range(1, n_blocks)})
    return cut(sorted(sample)), cut(sorted(w[::-1] for w in sample))


def asked_blocks(word: str, back: str, forward: list[str], backward: list[str]) -> tuple[int, range, range]:
    """(letters that the forward automata take exactly, forward blocks, backward blocks) to be asked for a word.

    The cut is the half, or the place next to it where the fewest blocks can hold the exact part.
    """
    n = len(word)

    def held(cuts: list[str], part: str) -> range:
        return range(bisect_right(cuts, part), bisect_right(cuts, part + LAST) + 1)

    best = None
    for cut in sorted(range(n + 1), key=lambda c: (abs(c - n // 2), c)):
        f, b = held(forward, word[:cut]), held(backward, back[: n - cut])
        if best is None or len(f) + len(b) < len(best[1]) + len(best[2]):
            best = (cut, f, b)
        if len(f) + len(b) <= 3:
            break
    return best


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n, n_near, best_n, best) of (word, n): how many words are near, and of them the one with the largest count."""
    spark = words.sparkSession
    total = words.count()
    n_blocks = min(MOST_BLOCKS, max(1, -(-total // block)))
    forward, backward = boundaries(words, total, n_blocks)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, asks, out, counts, cuts = [], [], [], [], []
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                back = word[::-1]
                cut, f, b = asked_blocks(word, back, forward, backward)
                # even numbers are forward blocks, odd ones backward
                places = [(2 * bisect_right(forward, word), False), (2 * bisect_right(backward, back) + 1, False), *((2 * i, True) for i in f), *((2 * i + 1, True) for i in b)]
                for part, ask in places:
                    parts.append(part)
                    asks.append(ask)
                    out.append(back if part % 2 else word)
                    counts.append(n)
                    cuts.append(len(word) - cut if part % 2 else cut)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(asks, pa.bool_()), pa.array(out, pa.string()), pa.array(counts, pa.int64()), pa.array(cuts, pa.int32())], ["part", "asks", "shown", "n", "exact"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, listed, counts, automaton = None, [], [], None
        for batch in batches:
            found: list[tuple] = []
            for part, ask, shown, n, exact in zip(*(c.to_pylist() for c in batch.columns)):
                if part != present:
                    present, listed, counts, automaton = part, [], [], None
                if not ask:
                    listed.append(shown)
                    counts.append(n)
                    continue
                if automaton is None:
                    automaton = Automaton(listed)
                near = automaton.near(shown, exact)
                if part % 2 and near:
                    # what shares the rest with the asking word is the forward automata's
                    head = shown[exact:]
                    near = {k for k in near if not listed[k].endswith(head)}
                if near:
                    turned = (lambda w: w[::-1]) if part % 2 else (lambda w: w)
                    most = max(counts[k] for k in near)
                    found.append((turned(shown), len(near), most, min(turned(listed[k]) for k in near if counts[k] == most)))
            columns = list(zip(*found)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "best_n", "best"])

    dealt = words.select("word", "n").mapInArrow(deal, "part int, asks boolean, shown string, n bigint, exact int")
    dealt = dealt.repartition(max(2 * n_blocks, 1), "part").sortWithinPartitions("part", "asks", "shown")
    met = dealt.mapInArrow(answer, "word string, n_near bigint, best_n bigint, best string")
    first = F.min_by(F.struct("best_n", "best"), F.struct((-F.col("best_n")).alias("k"), "best"))
    per_word = met.groupBy("word").agg(F.sum("n_near").alias("n_near"), first.alias("f"))
    return words.join(per_word, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.col("f.best_n").alias("best_n"), F.col("f.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form, ...) with ``root``: the last of the words reached by following forms, the word itself for none.

    Pointers double in each round, so there are as many rounds as the length of a chain has binary digits.
    """
    up = stage(forms.where("form is not null").select("word", F.col("form").alias("root")), "spelling_up")
    while True:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        new = stage(up.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "spelling_up")
        moved = not new.where("moved").isEmpty()
        discard(up)
        up = new.select("word", "root")
        up._stage_path = new._stage_path
        if not moved:
            return forms.join(up, "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_spellings(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of ``docs`` (doc_id, text).

    ``form`` is the near word with the largest count, if that is at least ``times`` the word's own.
    """
    words = stage(word_counts(docs, shortest, fewest), "spelling_words")
    near = near_words(words)
    holds = F.col("best_n") >= times * F.col("n")
    forms = stage(near.select("word", F.when(holds, F.col("best")).alias("form"), "n", "n_near", F.when(holds, F.col("best_n")).alias("form_n")), "spelling_forms")
    discard(words)
    return roots(forms).select("word", "form", "root", "n", "n_near", "form_n")
