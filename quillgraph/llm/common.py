"""What the operators share: staged tables, components, grouped runs and parts of batches.

Lineage is cut by tables written below ``spark.checkpoint.dir`` (see ``stage``), so a lost executor
costs only the tasks it ran: every later stage reads files that all executors can see.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quillgraph.operators.components import components
from quillgraph.sources.staging import discard, release, stage, workspace

__all__ = ["components", "discard", "free_name", "give_back", "release", "runs", "slices", "stage", "strings", "workspace"]


def strings(texts: pa.Array, begin: int = 0, end: int | None = None) -> pa.Array:
    """Rows of a string column with wide offsets from 0, as kernels for strings expect them; nulls are empty."""
    column = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1] or bytes(8), np.int64, len(column) + 1, column.offset * 8)[begin : None if end is None else end + 1]
    data = (column.buffers()[2] or pa.py_buffer(b"")).slice(int(offsets[0]), int(offsets[-1] - offsets[0]))
    return pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(offsets - offsets[0]), data])


def give_back() -> None:
    """Return memory that Python and Arrow have freed but keep, to the system; where the system has no such call, Arrow's alone."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores appended until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the consecutive rows that share ``key``, from batches that are sorted by it.

    Only the open run is held, so memory is bounded by the largest run; callers bound that by blocks.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *((column[1:] != column[:-1]).nonzero()[0] + 1).tolist(), len(column)]
        for begin, end in zip(cuts, cuts[1:]):
            part = batch.slice(begin, end - begin)
            if held and held[0].column(held[0].schema.get_field_index(key))[0].as_py() != column[begin]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def slices(batch: pa.RecordBatch, text: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of ``text`` each (one long row may be a part alone)."""
    size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, n in enumerate(size.tolist()):
        if i > begin and total + n > limit:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += n
    if begin < batch.num_rows:
        yield batch.slice(begin)
