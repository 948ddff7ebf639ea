"""Shards of near-equal bytes by Karmarkar-Karp differencing over indivisible groups.

A partial partition is a tuple of sums, one for each shard. The two with the largest spread are combined,
one in ascending and the other in descending order of sums, until one is left. Groups are dealt out over
tasks by their digest; each task differences ``UNIT`` groups at a time and hands on a partial partition of them.
Those are differenced ``FAN`` at a time, again in tasks, in rounds until one is left: three rounds for 10^12 groups.
The matchings of all rounds are tables; nothing but counts comes to the driver.

Defined results: a null text counts as empty; equal texts share a shard; repeated rows and null doc_ids are
placed like any others, and slots within a shard run from 0 without gaps. An empty table gives no rows. Texts are
hashed whole in the row, of any length. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.llm.common import discard, runs, stage

SHARDS, UNIT, FAN = 24, 32768, 4096


def difference(parts: list[list[int]], shards: int) -> tuple[list[list[int]], list[int]]:
    """(shard of each slot of each part, sums): parts are sums by slot; slots beyond a part's own are empty.

    Combined partitions keep a tree of how their slots were matched; it is unwound once at the end.
    """
    heap, tree = [], []
    for i, sums in enumerate(parts):
        padded = list(sums) + [0] * (shards - len(sums))
        order = sorted(range(shards), key=lambda s: (-padded[s], s))
        tree.append((i, order, None, None))
        heap.append((padded[order[-1]] - padded[order[0]], i, [padded[s] for s in order]))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, a = heapq.heappop(heap)
        _, j, b = heapq.heappop(heap)
        joined = [x + y for x, y in zip(a, reversed(b))]
        order = sorted(range(shards), key=joined.__getitem__, reverse=True)
        sums = [joined[s] for s in order]
        tree.append((i, order, j, [shards - 1 - s for s in order]))
        heapq.heappush(heap, (sums[-1] - sums[0], len(tree) - 1, sums))
    out: list[list[int]] = [[] for _ in parts]
    if not parts:
        return out, [0] * shards
    # where[node][s]: the final shard of the node's slot s
    where = {heap[0][1]: list(range(shards))}
    for node in range(len(tree) - 1, -1, -1):
        final = where.pop(node)
        left, left_order, right, right_order = tree[node]
        if right is None:
            back = [0] * shards
            for s, original in enumerate(left_order):
                back[original] = final[s]
            out[left] = back[: len(parts[left])]
            continue
        for child, order in ((left, left_order), (right, right_order)):
            back = [0] * shards
            for s, slot in enumerate(order):
                back[slot] = final[s]
            where[child] = back
    return out, heap[0][2]


def _units(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Tables of ``size`` rows, the last one smaller."""
    held, rows = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, size - rows)
            batch = batch.slice(part.num_rows)
            held.append(part)
            rows += part.num_rows
            if rows == size:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _local(shards: int):
    """Each task's groups, with their slots in a partial partition of the task and that partition's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 24
        for number, unit in enumerate(_units(batches, UNIT)):
            slots, _ = difference([[w] for w in unit.column(1).to_pylist()], shards)
            yield from unit.append_column("part", pa.array(np.full(unit.num_rows, task + number))).append_column("slot", pa.array([s[0] for s in slots], pa.int32())).combine_chunks().to_batches()

    return run


def _round(shards: int):
    """Of rows (unit, part, slot, w) by unit: each slot of each part, and its slot in the unit's partial partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in runs(batches, "unit"):
            parts, at = np.unique(unit.column("part").to_numpy(), return_inverse=True)
            slot = unit.column("slot").to_numpy()
            sums = np.zeros((len(parts), shards), np.int64)
            sums[at, slot] = unit.column("w").to_numpy()
            up = np.array(difference(sums.tolist(), shards)[0], np.int32)
            yield pa.RecordBatch.from_arrays([*(unit.column(n).combine_chunks() for n in ("unit", "part", "slot", "w")), pa.array(up[at, slot])], ["unit", "part", "slot", "w", "up"])

    return run


def matched(sums: DataFrame, shards: int) -> DataFrame:
    """(part, slot, shard): where the slots of all partial partitions ``sums`` (part, slot, w) end up."""
    steps = []
    while True:
        n = sums.select("part").distinct().count()
        units = max(1, -(-n // FAN))
        dealt = sums.withColumn("unit", F.pmod(F.xxhash64("part"), F.lit(units))).select("unit", "part", "slot", "w").repartition("unit").sortWithinPartitions("unit", "part")
        step = stage(dealt.mapInArrow(_round(shards), "unit bigint, part bigint, slot int, w bigint, up int"), "shard_steps")
        steps.append(step)
        if units == 1:
            break
        sums = step.groupBy(F.col("unit").alias("part"), F.col("up").alias("slot")).agg(F.sum("w").alias("w"))
    out = steps[-1].select("part", "slot", F.col("up").alias("shard"))
    for step in reversed(steps[:-1]):
        above = out.select(F.col("part").alias("unit"), F.col("slot").alias("up"), "shard")
        out = step.join(above, ["unit", "up"]).select("part", "slot", "shard")
    if len(steps) > 1:
        out = stage(out, "shard_matching")
        discard(*steps)
    else:
        out._stage_path = steps[0]._stage_path
    return out


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row's task and its place among the task's rows of the same shard."""
    task, seen = TaskContext.get().partitionId(), {}
    for batch in batches:
        shard = batch.column(batch.schema.get_field_index("shard")).to_numpy()
        place = np.empty(len(shard), np.int64)
        for s in np.unique(shard):
            at = (shard == s).nonzero()[0]
            place[at] = np.arange(len(at)) + seen.get(s, 0)
            seen[s] = seen.get(s, 0) + len(at)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(shard), task, np.int64)), pa.array(place)], [*batch.schema.names, "task", "place"])


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for every row of ``docs`` (doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stage(
        docs.select("doc_id", (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("digest")),
        "shard_rows",
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    groups = rows.groupBy("digest").agg(F.sum("size").alias("weight"))
    local = stage(groups.mapInArrow(_local(shards), "digest binary, weight bigint, part bigint, slot int"), "shard_groups")
    mapping = matched(local.groupBy("part", "slot").agg(F.sum("weight").alias("w")), shards)
    homes = local.join(mapping, ["part", "slot"]).select("digest", "shard")
    placed = rows.join(homes, "digest").select("doc_id", "size", "text_crc32", "shard")
    numbered = stage(placed.mapInArrow(_numbered, f"doc_id {kind}, size bigint, text_crc32 bigint, shard int, task bigint, place bigint"), "shard_places")
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = numbered.groupBy("shard", "task").agg(F.count("*").alias("n")).select("shard", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    discard(rows, local, mapping)
    return numbered.join(offsets, ["shard", "task"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("place")).alias("slot"))
