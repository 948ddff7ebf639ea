"""Product codes of vectors by delta-maintained Lloyd rounds in whole numbers.

Components become whole numbers and vectors are cut into equal consecutive parts, each with a codebook of its own.
Every part keeps its assignment in a staged table from round to round, and every entry the running sum and count of its
parts. A round is one pass over that table without a shuffle: it assigns the parts anew and writes old and new
assignments side by side. Then only parts whose assignment has changed contribute, less to the entry they leave and more
to the one they join, added up within each task before they are shuffled: a task hands on one row for each entry
at most, whatever the number of vectors. The sums are whole numbers, so running sums equal sums made anew, and neither
partitions nor retried tasks change the result.

What the driver holds is the codebook with its running sums: entries x dimensions, given by parameters and width alone.

Defined results: rows whose vector is null or holds null or non-finite components are dropped. The width is that of the
longest vector left, rounded up to a multiple of ``parts``; shorter and empty vectors are filled with zeros. Whole numbers
beyond ``largest(width)`` (2^27 for 64 components) either way are taken as that, so that squared distances fit 64 bits;
they are multiplied as doubles where those hold the results exactly, else as 64-bit integers. With fewer vectors than entries there are as many
entries as vectors. Repeated ids are rows like others, in order of their stored bytes where order counts; null ids come
last there. Ties go to the entry of lower index; entries that no part uses stay. Labels that are null count as one label. An
empty table gives no rows. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import discard, stage

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
STEP = 8192


def largest(width: int) -> int:
    """The largest whole number of which ``width`` squared differences fit 62 bits."""
    return math.isqrt((1 << 60) // width)


def whole_numbers(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> tuple[DataFrame, int]:
    """(vec_id, label, q as little-endian 32-bit integers) of the rows that are kept, and their width, 0 for none."""
    good = vectors.where(F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    longest = good.agg(F.max(F.size("x")).alias("n")).first().n
    if longest is None:
        return good.selectExpr("vec_id", "label", "cast(null as binary) as q"), 0
    width = max(parts, -(-longest // parts) * parts)
    most = largest(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2)
            sizes = np.diff(x.offsets.to_numpy())
            q = np.zeros((len(x), width), "<i4")
            # rows of one length at a time, nearly always all of them
            flat = np.clip(np.floor(x.flatten().to_numpy() * scale), -most, most).astype("<i4")
            ends = np.cumsum(sizes)
            for n in np.unique(sizes[sizes > 0]).tolist():
                rows = (sizes == n).nonzero()[0]
                q[rows, :n] = flat[(ends[rows] - n)[:, None] + np.arange(n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _binary(q)], ["vec_id", "label", "q"])

    kinds = {f.name: f.dataType.simpleString() for f in good.schema}
    return good.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, q binary"), width


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    rows = np.ascontiguousarray(rows)
    step = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * step).astype(np.int32)), pa.py_buffer(rows)])


def _matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    """Binary values of one length as a matrix."""
    offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
    return np.frombuffer(column.buffers()[2], kind, len(column) * width, int(offsets[0])).reshape(len(column), width)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, squared distance) of each row, in exact whole numbers; ties go to the lower index."""
    if 4 * x.shape[1] * int(max(np.abs(x).max(initial=0), np.abs(book).max(initial=0))) ** 2 <= 1 << 53:
        a, b = x.astype(np.float64), book.astype(np.float64)
        off = (b * b).sum(1) - 2 * (a @ b.T)
        at = off.argmin(1)
        return at, (off[np.arange(len(a)), at] + (a * a).sum(1)).astype(np.int64)
    a, b = x.astype(np.int64), book.astype(np.int64)
    at, least = np.zeros(len(a), np.int64), np.full(len(a), np.iinfo(np.int64).max)
    for k, entry in enumerate(b):
        off = ((a - entry) ** 2).sum(1)
        closer = off < least
        at[closer], least[closer] = k, off[closer]
    return at, least


def assign(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """``rows`` (vec_id, label, q, code) with the new ``code``, the former one as ``was`` and the squared error. One pass, no shuffle."""
    parts, _, own = books.shape
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, whole.num_rows, STEP):
                batch = whole.slice(begin, STEP)
                q = _matrix(batch.column(2), "<i4", parts * own)
                code, error = np.empty((len(q), parts), np.uint8), np.zeros(len(q), np.int64)
                for p in range(parts):
                    code[:, p], off = nearest(q[:, p * own : (p + 1) * own], books[p])
                    error += off
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], _binary(code), batch.column(3), pa.array(error)], ["vec_id", "label", "q", "code", "was", "error"])

    return rows.select("vec_id", "label", "q", "code").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, q binary, code binary, was binary, error bigint")


def changes(rows: DataFrame, parts: int, entries: int, width: int) -> DataFrame:
    """(part, entry, n, total): what the parts whose assignment differs from the former one add to each entry, or take from it."""
    own = width // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, own), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            q, code = _matrix(batch.column(0), "<i4", width).astype(np.int64), _matrix(batch.column(1), np.uint8, parts)
            there = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            was = np.zeros_like(code)
            if there.any():
                was[there] = _matrix(batch.column(2).filter(pa.array(there)), np.uint8, parts)
            for p in range(parts):
                part, moved = q[:, p * own : (p + 1) * own], ~there | (code[:, p] != was[:, p])
                np.add.at(n[p], code[moved, p], 1)
                np.add.at(total[p], code[moved, p], part[moved])
                left = moved & there
                np.add.at(n[p], was[left, p], -1)
                np.add.at(total[p], was[left, p], -part[left])
        at = np.argwhere((n != 0) | (total != 0).any(2))
        if len(at):
            p, e = at.T
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), pa.array(total[p, e].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    moved = rows.where("was is null or code <> was").select("q", "code", "was")
    handed = moved.mapInArrow(run, "part int, entry int, n bigint, total array<bigint>")
    return handed.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("total")[i]) for i in range(own))).alias("total"))


def compress_vectors(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code as one byte a part, error) of every vector (vec_id, embedding, label) kept, and the final codebooks (part, entry, component)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code is one byte a part, so there are 1 to 256 entries")
    numbers, width = whole_numbers(vectors, parts, scale)
    if not width:
        return numbers.selectExpr("vec_id", "label", "q as code", "cast(0 as bigint) as error"), np.zeros((parts, 0, 0), np.int64)
    rows = stage(numbers.withColumn("code", F.lit(None).cast("binary")), "codes")
    # at most ``entries`` rows, whatever the table's size
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(entries).select("q").collect()
    first = np.stack([np.frombuffer(r.q, "<i4") for r in first]).astype(np.int64)
    books = first.reshape(len(first), parts, width // parts).transpose(1, 0, 2)
    n, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
    for _ in range(rounds):
        new = stage(assign(rows, books), "codes")
        for r in changes(new, parts, books.shape[1], width).collect():  # one row an entry at most
            n[r.part, r.entry] += r.n
            total[r.part, r.entry] += np.array(r.total, np.int64)
        used = n > 0
        books = books.copy()
        books[used] = total[used] // n[used][:, None]
        discard(rows)
        rows = new
    return assign(rows, books).select("vec_id", "label", "code", "error"), books


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(vectors: DataFrame) -> DataFrame:
    """(vec_id, code in hexadecimal, error, label_error, codebooks_sha256) of every vector kept."""
    rows, books = compress_vectors(vectors)
    rows = stage(rows.select("vec_id", "label", F.lower(F.hex("code")).alias("code"), "error"), "codes_final")
    # a row for each label; the engine broadcasts it only if the file it reads is small enough, else it may split a hot label's join
    by_label = stage(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "codes_labels")
    same = rows["label"].eqNullSafe(by_label["label"])
    return rows.join(by_label, same).select("vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
