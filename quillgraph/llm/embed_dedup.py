"""Near-duplicate vectors by cross-polytope hashing with multiprobe buckets and verified pairs.

A vector is turned by pseudo-random rotations (three rounds of random signs and a fast Hadamard transform)
and hashed to the nearest signed axis; a code joins the axes of some rotations. For every table the vector
lies in its own bucket and in those reached by the next-best axis of any of the rotations. All pairs
that share a bucket are verified by their cosine in double precision.

How many rotations a code joins follows from the number of vectors, so that a bucket of unlike vectors keeps its
expected size, at most ``MEET`` of them, at any scale; how many tables there are follows from the chance that a
pair at the threshold shares a bucket, so that it misses all with a chance of ``MISS`` at most (see ``plan``).

Buckets are split into cells of two blocks of at most ``BLOCK`` vectors, multiplied as matrices; a cell hands
on sums and a spanning forest, a row for each vector at most, never its pairs. A pair that meets in several
buckets is counted in the first of them only, told from the codes both vectors carry. Equal vectors are one
node with a weight from the start, so a copied vector fills no bucket.

Defined results: null and empty vectors, zero vectors and those with null or non-finite components link with
nothing: n_links 0, component_id their own id, kept true. Vectors of different lengths never link. Components of any
finite size are scaled before their squares are summed. Null ids have component_id null and kept true and still
count as links of others. Repeated rows are links of each other. An empty table gives no rows. Other columns, whatever
their names, are not read. A vector is held whole, of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.llm.common import components, discard, stage

MEET, MISS, BLOCK, SEED = 64, 1e-4, 2048, 7
#: Cells up to SMALL rows are looked through many at a time, in tables of about so many rows.
SMALL, TABLE = 256, 20_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths; the width is a power of two."""
    n, width = x.shape
    h = 1
    while h < width:
        x = x.reshape(n, width // (2 * h), 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        h *= 2
    return x.reshape(n, width) / np.sqrt(width)


def _width(d: int) -> int:
    return 1 << max(1, (d - 1).bit_length())


@lru_cache(8)
def _signs(width: int, rotations: int) -> np.ndarray:
    return np.random.default_rng([SEED, width]).choice([-1.0, 1.0], (rotations, 3, width))


def _two_axes(padded: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """(rows, 2): the nearest signed axis and the next one after a rotation."""
    y = padded
    for s in signs:
        y = hadamard(y * s)
    top = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
    size = np.take_along_axis(np.abs(y), top, axis=1)
    top = np.where((size[:, :1] >= size[:, 1:]), top, top[:, ::-1])
    return 2 * top + (np.take_along_axis(y, top, axis=1) < 0)


@lru_cache(64)
def hit_rate(d: int, cosine: float) -> float:
    """The chance that two vectors at the threshold have one of their two nearest axes in common, by simulation."""
    rng = np.random.default_rng(SEED)
    x, z = rng.normal(size=(2, 64, d))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    size = np.linalg.norm(z, axis=1, keepdims=True)
    y = cosine * x + np.sqrt(max(0.0, 1 - cosine**2)) * np.divide(z, size, out=np.zeros_like(z), where=size > 1e-9)
    width = _width(d)
    x, y = (np.pad(v, ((0, 0), (0, width - d))) for v in (x, y))
    met = [(_two_axes(x, s)[:, :, None] == _two_axes(y, s)[:, None, :]).any(axis=(1, 2)) for s in _signs(width, 64)]
    return min(0.99, max(0.05, float(np.mean(met))))


@lru_cache(64)
def plan(rows: int, d: int, cosine: float) -> tuple[int, int]:
    """(rotations of a code, tables) for so many vectors of length d."""
    k, axes = 2, 2 * _width(d)
    while rows * (2 / axes) ** k > MEET and k < 16 and axes ** (k + 1) < 2**62:
        k += 1
    return k, max(2, ceil(log(MISS) / log(1 - hit_rate(d, cosine) ** k)))


def bucket_codes(x: np.ndarray, k: int, tables: int) -> np.ndarray:
    """(rows, tables, 2**k) codes of vectors of one length by table; the first is the vector's own bucket."""
    n, d = x.shape
    width = _width(d)
    padded = np.zeros((n, width))
    padded[:, :d] = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = np.empty((n, tables, 2**k), np.int64)
    signs = _signs(width, tables * k)
    for t in range(tables):
        best = [_two_axes(padded, s) for s in signs[t * k : (t + 1) * k]]
        for p, probe in enumerate(product((0, 1), repeat=k)):
            code = np.zeros(n, np.int64)
            for b, i in zip(best, probe):
                code = code * 2 * width + b[:, i]
            out[:, t, p] = code
    return out if (2 * width) ** k >= 2**31 else out.astype(np.int32)


def bucket_keys(codes: np.ndarray, d: int) -> np.ndarray:
    """64-bit keys of (length, table, code)."""
    h = codes.astype(np.uint64) + np.arange(codes.shape[1], dtype=np.uint64)[None, :, None] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(d * 0xD6E8FEB86659FD93 % 2**64)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def _vectors(kind: type):
    """(vec_id, digest, vec): components end to end in the column's precision; null for what links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind) + kind(0.0)
            ends = np.cumsum(size)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            some = np.concatenate([[0], np.cumsum(flat != 0)])
            good = (size > 0) & (bad[ends] == bad[ends - size]) & (some[ends] > some[ends - size])
            raw = [flat[e - n : e].tobytes() if g else None for e, n, g in zip(ends.tolist(), size.tolist(), good.tolist())]
            digests = [None if r is None else hashlib.sha256(r).digest()[:16] for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(raw, pa.binary())], ["vec_id", "digest", "vec"])

    return run


def _matrix(raw: list[bytes], kind: type) -> np.ndarray:
    """Rows in double precision, scaled by powers of two so that squares stay finite."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _keys(kind: type, rows: int, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, raw = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            length = np.array([len(r) for r in raw])
            for size in np.unique(length).tolist():
                d = size // np.dtype(kind).itemsize
                k, tables = plan(rows, d, cosine)
                own = (length == size).nonzero()[0]
                step = max(1, 2_000_000 // _width(d))
                for at in (own[i : i + step] for i in range(0, len(own), step)):
                    codes = bucket_codes(_matrix([raw[i] for i in at], kind), k, tables)
                    keys = bucket_keys(codes, d).reshape(len(at), -1)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32()), pa.array(keys.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array(node[at]), lists, pa.array([c.tobytes() for c in codes], pa.binary())], ["node", "keys", "codes"])

    return run


def _first_here(ci: np.ndarray, cj: np.ndarray, table: int, code: int) -> np.ndarray:
    """Which of the pairs (rows of codes by table and probe) share no bucket before this one."""
    out = np.ones(len(ci), bool)
    for t in range(table + 1):
        same = ci[:, t, :, None] == cj[:, t, None, :]
        if t < table:
            out &= ~same.any(axis=(1, 2))
        else:
            out &= np.where(same.any(axis=2), ci[:, t], np.iinfo(ci.dtype).max).min(axis=1) == code
    return out


def _verified(kind: type, rows: int, cosine: float):
    def of_length(cell: pa.Table, d: int) -> Iterator[pa.RecordBatch]:
        node, side, weight = cell.column("node").to_numpy(), cell.column("side").to_numpy(), cell.column("weight").to_numpy()
        x = _matrix(cell.column("vec").to_pylist(), kind)
        k, tables = plan(rows, d, cosine)
        wide = np.int64 if (2 * _width(d)) ** k >= 2**31 else np.int32
        codes = np.frombuffer(b"".join(cell.column("codes").to_pylist()), wide).reshape(len(node), tables, 2**k)
        table, probe = np.argwhere(bucket_keys(codes[:1], d)[0] == cell.column("key")[0].as_py())[0]
        code = int(codes[0, table, probe])
        norm = np.linalg.norm(x, axis=1)
        alone = (side == 2).all()
        left, right = (np.arange(len(node)),) * 2 if alone else ((side == 0).nonzero()[0], (side == 1).nonzero()[0])
        links, label = np.zeros(len(node), np.int64), np.arange(len(node))
        for begin in range(0, len(left), 256):
            part = left[begin : begin + 256]
            near = (x[part] @ x[right].T) / (norm[part, None] * norm[right]) >= cosine
            i, j = near.nonzero()
            i, j = part[i], right[j]
            if alone:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            while True:
                low = np.minimum(label[i], label[j])
                before = label.copy()
                np.minimum.at(label, i, low)
                np.minimum.at(label, j, low)
                label = label[label]
                if (label == before).all():
                    break
            for at in range(0, len(i), 50_000):
                a, b = i[at : at + 50_000], j[at : at + 50_000]
                new = _first_here(codes[a], codes[b], int(table), code)
                np.add.at(links, a[new], weight[b[new]])
                np.add.at(links, b[new], weight[a[new]])
        # later parts may have joined labels of earlier ones
        while (label[label] != label).any():
            label = label[label]
        told = ((links > 0) | (label != np.arange(len(node)))).nonzero()[0]
        if len(told):
            yield pa.RecordBatch.from_arrays([pa.array(node[told]), pa.array(node[label[told]]), pa.array(links[told])], ["node", "root", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_cells(batches):
            cell, side = table.column("cell").to_numpy(), table.column("side").to_numpy()
            starts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            ends = np.append(starts[1:], len(cell))
            large = (ends - starts > SMALL) | (np.minimum.reduceat(side, starts) < 2)
            length = np.array([len(v.as_buffer()) for v in table.column("vec")])
            plain = len(np.unique(length)) == 1
            near = ~_apart(table, starts, ends, large, kind, cosine) if plain else np.ones(len(starts), bool)
            for begin, end in zip(starts[near].tolist(), ends[near].tolist()):
                for size in np.unique(length[begin:end]).tolist():  # one, unless keys of different lengths are equal by chance
                    at = begin + np.flatnonzero(length[begin:end] == size)
                    yield from of_length(table.take(pa.array(at)), size // np.dtype(kind).itemsize)

    return run


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of some whole cells each, from batches that are sorted by cell."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column(batch.schema.get_field_index("cell")).to_numpy()
        if rows + batch.num_rows >= TABLE:
            borders = np.flatnonzero(cell[1:] != cell[:-1])
            cut = int(borders[-1]) + 1 if len(borders) else 0
            if held and not cut and held[-1].column(held[-1].schema.get_field_index("cell"))[-1].as_py() != cell[0]:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
            if cut:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held, rows, batch = [], 0, batch.slice(cut)
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _apart(table: pa.Table, starts: np.ndarray, ends: np.ndarray, large: np.ndarray, kind: type, cosine: float) -> np.ndarray:
    """Which cells, but for large ones, hold no pair at the threshold; of vectors of one length."""
    x = _matrix(table.column("vec").to_pylist(), kind)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = ~large
    cell = np.repeat(np.arange(len(starts)), ends - starts)
    later = np.where(large[cell], 0, ends[cell] - np.arange(len(cell)) - 1)
    at, total = 0, np.cumsum(later)
    while at < len(later):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + 20_000)))
        count = later[at:stop]
        i = np.repeat(np.arange(at, stop), count)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
        # a little below the threshold; the cell's own look decides
        out[cell[i[np.einsum("nd,nd->n", x[i], x[j]) >= cosine - 1e-9]]] = False
        at = stop
    return out


def near_vectors(vectors: DataFrame, cosine: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding)."""
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    kind = np.float32 if isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType) else np.float64
    given = vectors.select("vec_id", F.col("embedding").cast("array<float>" if kind is np.float32 else "array<double>").alias("embedding"))
    rows = stage(given.mapInArrow(_vectors(kind), f"vec_id {id_type}, digest binary, vec binary"), "vec_rows")
    nodes = stage(rows.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("vec").alias("vec")).withColumn("node", F.monotonically_increasing_id()), "vec_nodes")
    # a power of two, so that a few vectors more do not move all buckets
    n = 1 << max(0, nodes.count() - 1).bit_length()
    keyed = stage(nodes.select("node", "vec").mapInArrow(_keys(kind, n, cosine), "node bigint, keys array<bigint>, codes binary"), "vec_keys")
    flat = keyed.select("node", F.explode("keys").alias("key"))
    busy = flat.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    placed = flat.join(busy, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    cells = placed.select("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "node", side.alias("side"))
    # the two blocks of a cell off the diagonal hold one side each; a block on the diagonal meets itself
    full = cells.join(nodes.select("node", "weight", "vec").join(keyed.select("node", "codes"), "node"), "node").repartition("cell").sortWithinPartitions("cell")
    told = stage(full.mapInArrow(_verified(kind, n, cosine), "node bigint, root bigint, links bigint"), "vec_told")
    links = told.groupBy("node").agg(F.sum("links").alias("links"))
    comps = components(told.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).distinct(), "vec_comps")
    lowest = comps.join(nodes.select("node", "rep"), "node").groupBy("component").agg(F.min("rep").alias("lowest"))
    member = nodes.select("node", "digest", "rep", "weight").join(links, "node", "left").join(comps, "node", "left").join(lowest, "component", "left")
    member = member.select("digest", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("lowest", "rep").alias("component_id"))
    judged = rows.select("vec_id", "digest").join(member, "digest", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    out = stage(judged.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")), "vec_judged")
    discard(rows, nodes, keyed, told, comps)
    return out
