"""MinHash near-duplicate detection by a multi-index Hamming join.

Each text becomes the set of its word shingles and a signature of K symbols of 16 bits. Two sets of
similarity J differ in each symbol with probability 1 - J, so linked texts lie within T symbols of each
other but for a chance of ``MISS``. The signature is cut into m chunks, with 2 m > T: by the pigeonhole
principle any pair within distance T has a chunk with at most one error. All such chunks are enumerated
by leaving out each symbol in turn, so K keys for a text find *every* pair within T, never a sample.
Pairs beyond T are left alone wherever they meet, so a link depends on its two texts and on nothing else.

A bucket is never expanded into all its pairs. The join goes in two rounds:

1. rows are dealt by ranges of (key, a random order of nodes), so no bucket lies in one task; each text meets its
   neighbour in that order, the nearest few partners of each text are verified on the full sets, and links are
   closed to components;
2. pairs that meet in a bucket but still lie in different components are verified, all of them: small
   buckets by a join, large ones in cells of bounded size, where a block of the outsiders of the bucket (those
   beyond its largest component) meets a block of its rows, by signature first, then on the full sets.

So no link between different components stays unseen, while a group of n copies costs O(n) rows.
Equal sets are one node from the start.

Defined results: a null or wordless text has an empty set, n_shingles 0, and stands alone. Rows with a null
id are returned with component_id null and kept true. Repeated rows are copies of each other. Ties go to the
smallest id. An empty table gives no rows. A text is read whole by one task, which needs some ten times its size.
Other columns of the input, whatever their names, are ignored, and passed on by ``drop_near_duplicates``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import components, discard, free_name, runs, slices, stage, strings

MISS = 1e-4
#: Buckets up to SMALL rows are joined; cells of larger ones hold at most so many rows or shingles a side. NEAREST partners are verified first.
SMALL, BLOCK, BLOCK_SHINGLES, NEAREST = 32, 1024, 500_000, 4


@lru_cache
def plan(similarity: float) -> tuple[int, int, int]:
    """(K symbols, m chunks, T distance) for which a pair at the threshold lies beyond T with chance MISS at most."""
    for k in range(32, 1000, 8):
        m = int(k / 4.6)
        t = 2 * m - 1
        p = 1 - similarity
        if sum(comb(k, i) * p**i * (1 - p) ** (k - i) for i in range(t + 1, k + 1)) <= MISS:
            return k, m, t
    raise ValueError("similarity is too low for this signature")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache
def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, ends): the sorted 64-bit hashes of each text's distinct shingles of ``width`` words, end to end; a shorter text is one shingle."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(strings(texts)))
    words = split.flatten()
    # white space at the ends gives empty words
    filled = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    counted = np.concatenate([[0], np.cumsum(filled)])
    offsets = counted[split.offsets.to_numpy()]
    numbered = words.filter(pa.array(filled)).dictionary_encode()
    known = pd.util.hash_array(np.array(numbered.dictionary.to_pylist(), dtype=object), categorize=False) if len(numbered.dictionary) else np.empty(0, np.uint64)
    hashes = np.concatenate([known[numbered.indices.to_numpy()], np.zeros(width, np.uint64)])
    n = np.diff(offsets)
    shingles = np.where(n > 0, np.maximum(n - width + 1, 1), 0)
    ends = np.cumsum(shingles)
    row = np.repeat(np.arange(len(n)), shingles)
    at = offsets[row] + np.arange(len(row)) - (ends - shingles)[row]
    factor = _multipliers(width + 1)
    total = np.minimum(n, width).astype(np.uint64)[row] * factor[width]
    short = (n < width).any()
    for i in range(width):
        part = hashes[at + i] * factor[i]
        total += part * (i < n[row]) if short else part
    total = _mix(total)
    for begin, end in zip((ends - shingles).tolist(), ends.tolist()):
        total[begin:end].sort()
    fresh = np.ones(len(total), bool)
    fresh[1:] = total[1:] != total[:-1]
    fresh[(ends - shingles)[shingles > 0]] = True
    return total[fresh], np.concatenate([[0], np.cumsum(fresh)])[ends]


def signatures(values: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """(sets, k): the lowest 16 bits of k minimums, each over another permutation of a set's hashes. No set is empty."""
    factors = _multipliers(k + 64)[64:]
    starts = np.concatenate([[0], ends[:-1]])
    out = np.empty((len(ends), k), np.uint64)
    begin = 0
    while begin < len(ends):
        end = max(begin + 1, int(np.searchsorted(ends, starts[begin] + 32_768, "right")))
        own, at = values[starts[begin] : ends[end - 1]], starts[begin:end] - starts[begin]
        for i, f in enumerate(factors):
            mixed = own * f
            mixed ^= mixed >> np.uint64(32)
            out[begin:end, i] = np.minimum.reduceat(mixed, at)
        begin = end
    return (_mix(out) & np.uint64(0xFFFF)).astype(np.uint16).view(np.int16)


def _digests(values: np.ndarray, ends: np.ndarray) -> list[bytes]:
    return [hashlib.sha256(values[a:b]).digest()[:16] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, rows.size + 1, rows.shape[1]), pa.int32()), pa.array(rows.ravel()))


def _signatures(width: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4_000_000):
                values, ends = shingle_sets(batch.column(2), width)
                size = np.diff(ends, prepend=0)
                some = size > 0
                place = pa.array(np.cumsum(some) - 1, mask=~some)
                digests, signed = pa.array(_digests(values, ends[some]), pa.binary()), _lists(signatures(values, ends[some], k))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), digests.take(place), signed.take(place)], ["doc_id", "mark", "n_shingles", "digest", "sig"])

    return run


def _full_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 4_000_000):
                values, ends = shingle_sets(batch.column(2), width)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values.view(np.int64)))
                same = pa.array([a == b for a, b in zip(_digests(values, ends), batch.column(1).to_pylist())], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["node", "members"]).filter(same)

    return run


def _chunks(k: int, m: int) -> list[range]:
    return [range(k * i // m, k * (i + 1) // m) for i in range(m)]


def chunk_keys(sig: Column, k: int, m: int) -> list[Column]:
    """Every key of a signature: each chunk with each of its symbols left out."""
    return [F.xxhash64(F.lit(i * 1000 + gap - c.start), *(sig[x] for x in c if x != gap)) for i, c in enumerate(_chunks(k, m)) for gap in c]


def _distance(a: str, b: str) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x != y), lambda x: x))


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node) in order: those with a neighbour of their key in this range, and its first and last row in any case."""
    part, held = TaskContext.get().partitionId(), None

    def told(table: pa.RecordBatch, before: tuple | None, after: tuple | None) -> pa.RecordBatch:
        key, node = (table.column(i).to_numpy() for i in (0, 1))
        same = key[1:] == key[:-1]
        up, down = np.append(before is not None and before[0] == key[0], same), np.append(same, after is not None and after[0] == key[-1])
        edge = np.zeros(len(key), bool)
        edge[0], edge[-1] = before is None, after is None
        prev = np.append(before[1] if up[0] else 0, node[:-1])
        keep = up | down | edge
        return pa.RecordBatch.from_arrays([
            pa.array(key[keep]), pa.array(node[keep]), pa.array(prev[keep], mask=~up[keep]), pa.array((up | down)[keep]), pa.array(edge[keep]), pa.array(np.full(keep.sum(), part, np.int32)),
        ], ["key", "node", "prev", "mate", "edge", "part"])

    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        first = (batch.column(0)[0].as_py(), batch.column(1)[0].as_py())
        if held is not None:
            yield told(held, before, first)
            before = (held.column(0)[-1].as_py(), held.column(1)[-1].as_py())
        held = batch
    if held is not None:
        yield told(held, before, None)


def buckets_of(keyed: DataFrame) -> DataFrame:
    """(key, node, prev, other): rows of ``keyed`` (key, node) that share their key with another, each but one of a key with one or two earlier ones.

    Rows are dealt by ranges, which split a key as finely as need be. What lies at the ends of ranges, two rows
    each, is then put together by key.
    """
    mixed = F.xxhash64("node", "key")
    dealt = keyed.repartitionByRange("key", mixed, "node").sortWithinPartitions("key", mixed, "node").select("key", "node")
    marks = stage(dealt.mapInArrow(_neighbours, "key bigint, node bigint, prev bigint, mate boolean, edge boolean, part int"), "near_marks")
    in_key = Window.partitionBy("key").orderBy("part", F.xxhash64("node", "key"), "node")
    ends = marks.where("edge").withColumn("other", F.lag("node").over(in_key)).withColumn("next", F.lead("node").over(in_key)).where("mate or other is not null or next is not null")
    out = stage(marks.where("mate and not edge").select("key", "node", "prev", F.lit(None).cast("bigint").alias("other")).union(ends.select("key", "node", "prev", "other")), "near_buckets")
    discard(marks)
    return out


def _outsiders(percent: int, limit: int):
    """Links between outsiders and rows of a cell within ``limit`` symbols, confirmed on the full sets: one for each outsider and component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, "unit"):
            outside = group.column("outside").to_numpy()
            q, r = outside.nonzero()[0], (~outside).nonzero()[0]
            if not len(q) or not len(r):
                continue
            node, comp = group.column("node").to_numpy(), group.column("component").to_numpy()
            sig = group.column("sig").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
            sets = group.column("members").combine_chunks()
            values = np.unique(sets.flatten().to_numpy(), return_inverse=True)[1]
            ends = np.cumsum(sets.value_lengths().to_numpy())
            starts = np.concatenate([[0], ends[:-1]])
            size = ends - starts
            mark = np.zeros(values.max() + 1, np.int32)
            for i in q:
                near = r[((sig[r] != sig[i]).sum(axis=1) <= limit) & (comp[r] != comp[i])]
                if not len(near):
                    continue
                own = values[starts[i] : ends[i]]
                mark[own] = 1
                theirs = np.concatenate([values[starts[j] : ends[j]] for j in near])
                both = np.add.reduceat(mark[theirs], np.concatenate([[0], np.cumsum(size[near])[:-1]]))
                mark[own] = 0
                linked = near[100 * both >= percent * (size[i] + size[near] - both)]
                if len(linked):
                    linked = linked[np.unique(comp[linked], return_index=True)[1]]
                    a, b = np.full(len(linked), node[i]), node[linked]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return run


def _judged(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(doc_id, mark, n_shingles, lowest) for every row of ``docs`` (doc_id, mark, text): lowest is the least (doc_id, mark) that links reach, null for rows that link with nothing."""
    k, m, limit = plan(similarity)
    percent = round(similarity * 100)
    texts = docs.select("doc_id", "mark", F.col("text").cast("string").alias("text"))
    kinds = {c: docs.schema[c].dataType.simpleString() for c in ("doc_id", "mark")}
    sigs = stage(texts.mapInArrow(_signatures(width, k), f"doc_id {kinds['doc_id']}, mark {kinds['mark']}, n_shingles bigint, digest binary, sig array<smallint>"), "near_sigs")
    classes = stage(
        sigs.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(F.struct("doc_id", "mark")).alias("rep"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
        .withColumn("node", F.monotonically_increasing_id()),
        "near_classes",
    )
    buckets = buckets_of(classes.select("node", F.explode(F.array(*chunk_keys(F.col("sig"), k, m))).alias("key")))
    met = buckets.select("node").distinct()
    chosen = classes.join(met, "node").select("node", "digest", "rep", "n")
    whole = texts.join(chosen, (texts.doc_id == F.col("rep.doc_id")) & texts.mark.eqNullSafe(F.col("rep.mark"))).select("node", "digest", "text")
    full = stage(whole.mapInArrow(_full_sets(width), "node bigint, members array<bigint>").dropDuplicates(["node"]), "near_sets")
    sig = classes.select("node", "sig")

    def near(pairs: DataFrame) -> DataFrame:
        left, right = (sig.select(F.col("node").alias(x), F.col("sig").alias("s" + x)) for x in "ab")
        return pairs.join(left, "a").join(right, "b").select("a", "b", _distance("sa", "sb").alias("d")).where(F.col("d") <= limit)

    def verified(pairs: DataFrame) -> DataFrame:
        left, right = (full.select(F.col("node").alias(x), F.col("members").alias("m" + x)) for x in "ab")
        both = F.size(F.array_intersect("ma", "mb"))
        return pairs.join(left, "a").join(right, "b").withColumn("both", both).where(100 * F.col("both") >= percent * (F.size("ma") + F.size("mb") - F.col("both"))).select("a", "b")

    met_pairs = buckets.select("node", F.explode(F.array("prev", "other")).alias("prev")).where("prev is not null")
    sided = stage(near(met_pairs.select(F.least("node", "prev").alias("a"), F.greatest("node", "prev").alias("b")).distinct()), "near_sided")
    per_node = Window.partitionBy("n").orderBy("d", "o")
    best = sided.select(F.col("a").alias("n"), F.col("b").alias("o"), "d").union(sided.select(F.col("b"), F.col("a"), "d")).withColumn("r", F.row_number().over(per_node)).where(F.col("r") <= NEAREST)
    links1 = stage(verified(best.select(F.least("n", "o").alias("a"), F.greatest("n", "o").alias("b")).distinct()), "near_links")
    comps1 = components(links1, "near_comps")

    # second round: whatever meets in a bucket and is still apart
    placed = buckets.select("key", "node").join(comps1, "node", "left").withColumn("component", F.coalesce("component", "node"))
    sizes = chosen.select("node", F.col("n").alias("size"))
    per_comp = placed.join(sizes, "node").groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("size").alias("size"))
    main = F.max_by(F.struct("component", "c", "size"), F.struct("c", "component"))
    mixed = per_comp.groupBy("key").agg(F.sum("c").alias("n"), F.sum("size").alias("size"), F.count("*").alias("parts"), main.alias("main")).where("parts > 1")
    blocks = lambda rows, size: F.ceil(F.greatest(rows / BLOCK, size / BLOCK_SHINGLES)).cast("int")
    mixed = mixed.select("key", "n", F.col("main.component").alias("main"), blocks(F.col("n"), F.col("size")).alias("inner"), blocks(F.col("n") - F.col("main.c"), F.col("size") - F.col("main.size")).alias("outer"))
    open_ = stage(placed.join(mixed, "key"), "near_open")
    small = open_.where(F.col("n") <= SMALL)
    pairs_small = small.alias("x").join(small.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component"))).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("other")
    large = open_.where(F.col("n") > SMALL)
    # every row of a bucket goes to each block of outsiders, mostly one, and only outsiders to every block of rows
    cells = large.select("key", "node", "component", block("inner").alias("own"), every("outer")).select("node", "component", F.lit(False).alias("outside"), F.xxhash64("key", "own", "other").alias("unit")).union(
        large.where("component <> main").select("key", "node", "component", block("outer").alias("own"), every("inner")).select("node", "component", F.lit(True).alias("outside"), F.xxhash64("key", "other", "own").alias("unit"))
    )
    units = cells.join(full.join(sig, "node"), "node").select("unit", "node", "component", "outside", "sig", "members").repartition("unit").sortWithinPartitions("unit")
    met_large = units.mapInArrow(_outsiders(percent, limit), "a bigint, b bigint")
    rest = near(pairs_small.distinct()).select("a", "b")
    links2 = stage(verified(rest).union(met_large), "near_links2")
    comps = components(links1.union(links2), "near_comps")
    lowest = comps.join(classes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("lowest"))
    member = classes.select("node", "digest", "rep").join(comps, "node", "left").join(lowest, "component", "left").select("digest", F.coalesce("lowest", "rep").alias("lowest"))
    out = stage(sigs.select("doc_id", "mark", "n_shingles", "digest").join(member, "digest", "left").select("doc_id", "mark", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("lowest")).alias("lowest")), "near_judged")
    discard(sigs, classes, buckets, full, sided, open_, links1, comps1, links2, comps)
    return out


def near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text).

    Two texts are linked when the Jaccard similarity of their sets of ``width``-word shingles is at least
    ``similarity`` (compared in whole hundredths, exactly). component_id is the smallest id reachable.
    """
    judged = _judged(docs.select("doc_id", F.lit(0).alias("mark"), "text"), width, similarity)
    component = F.coalesce("lowest.doc_id", "doc_id")
    return judged.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: of each group of near duplicates the one with the smallest doc_id, and of its texts the one with the least digest.

    Rows are told apart by id and text, so a repeated doc_id costs no text that is a copy of nothing. Of rows equal in
    both one stays, whichever it is where other columns differ. Rows without an id or without words all stay.
    """
    mark = free_name(docs.columns, "mark")
    marked = docs.withColumn(mark, F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"))))
    judged = _judged(marked.select("doc_id", F.col(mark).alias("mark"), "text"), width, similarity)
    gone = judged.where((F.col("doc_id") != F.col("lowest.doc_id")) | (F.col("mark") != F.col("lowest.mark"))).select("doc_id", F.col("mark").alias(mark)).distinct()
    stay = marked.join(gone, ["doc_id", mark], "left_anti")
    plain = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return stay.where(plain).unionByName(stay.where(~plain).dropDuplicates(["doc_id", mark])).select(docs.columns)
