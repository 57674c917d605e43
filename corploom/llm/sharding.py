"""Sharding of indivisible groups by best-fit-decreasing bin packing.

Groups are the rows with equal texts.  A group's size goes, largest first, into
the open bin with the least remaining capacity that takes it, found in a
balanced search tree; a new bin opens only where none does, which keeps the
number of fixed-capacity bins small.

That runs at two levels so that no task and no driver sees all groups.  Each
task packs its groups, sorted by Spark, into crates of a small fixed capacity;
a group above that capacity is a crate of its own.  The driver packs crates
into shards: their number is bounded by 2 T / c + P for a total size T, crate
capacity c = T / (shards x crates_per_shard) and P tasks, whatever the number
of documents.  Given a number of shards, it takes the least capacity at which
best-fit-decreasing needs no more, beside shards for groups above the mean.

Cases: a null text counts as empty, so null and empty texts are one group;
repeated rows are rows of their own in the group of their text; a group that
holds a third of all rows is summed before the shuffle, stays whole, and its
rows are numbered in many tasks; an empty table gives an empty result; other
columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corploom.llm import shared


class _Node:
    __slots__ = ("key", "left", "level", "right")

    def __init__(self, key: tuple[int, int]) -> None:
        self.key, self.level = key, 1
        self.left: _Node | None = None
        self.right: _Node | None = None


def _skew(t: _Node) -> _Node:
    a = t.left
    if a is not None and a.level == t.level:
        t.left, a.right = a.right, t
        return a
    return t


def _split(t: _Node) -> _Node:
    b = t.right
    if b is not None and b.right is not None and b.right.level == t.level:
        t.right, b.left = b.left, t
        b.level += 1
        return b
    return t


def _insert(t: _Node | None, key: tuple[int, int]) -> _Node:
    if t is None:
        return _Node(key)
    if key < t.key:
        t.left = _insert(t.left, key)
    else:
        t.right = _insert(t.right, key)
    return _split(_skew(t))


def _delete(t: _Node | None, key: tuple[int, int]) -> _Node | None:
    if t is None:
        return None
    if key < t.key:
        t.left = _delete(t.left, key)
    elif key > t.key:
        t.right = _delete(t.right, key)
    elif t.left is None:
        return t.right
    elif t.right is None:
        return t.left
    else:
        heir = t.right
        while heir.left is not None:
            heir = heir.left
        t.key = heir.key
        t.right = _delete(t.right, heir.key)
    low = min(t.left.level if t.left else 0, t.right.level if t.right else 0) + 1
    if low < t.level:
        t.level = low
        if t.right is not None and low < t.right.level:
            t.right.level = low
    t = _skew(t)
    if t.right is not None:
        t.right = _skew(t.right)
        if t.right.right is not None:
            t.right.right = _skew(t.right.right)
    t = _split(t)
    if t.right is not None:
        t.right = _split(t.right)
    return t


class Bins:
    """Open bins in a balanced (AA) tree by remaining capacity."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.count = capacity, 0
        self.root: _Node | None = None

    def add(self, size: int) -> int:
        """The bin that a group goes to: the tightest that takes it, else a new one."""
        if size >= self.capacity:
            self.count += 1
            return self.count - 1
        best, t, need = None, self.root, (size, -1)
        while t is not None:
            if t.key >= need:
                best, t = t.key, t.left
            else:
                t = t.right
        if best is None:
            best = (self.capacity, self.count)
            self.count += 1
        else:
            self.root = _delete(self.root, best)
        if best[0] > size:
            self.root = _insert(self.root, (best[0] - size, best[1]))
        return best[1]


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size; bins are numbered as they open."""
    bins, out = Bins(capacity), [0] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        out[k] = bins.add(sizes[k])
    return out


def pack_into(sizes: list[int], shards: int) -> list[int]:
    """A shard from 0 for each size, with sums as near to equal as indivisible sizes let them be.

    A size above the mean of the shards left has a shard to itself.  The others
    go by best-fit-decreasing into what is left, under the least capacity found
    at which that needs no more shards.
    """
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    out, left = [0] * len(sizes), sum(sizes)
    alone = 0
    while alone < len(order) and alone < shards - 1 and sizes[order[alone]] * (shards - alone) > left:
        out[order[alone]] = alone
        left -= sizes[order[alone]]
        alone += 1
    rest = order[alone:]
    for k, shard in zip(rest, _least_capacity([sizes[k] for k in rest], shards - alone)):
        out[k] = alone + shard
    return out


def _least_capacity(sizes: list[int], shards: int) -> list[int]:
    low = max([-(-sum(sizes) // shards), *sizes], default=1)
    high = low
    while True:
        plan = best_fit_decreasing(sizes, high)
        if max(plan, default=0) < shards:
            break
        low, high = high + 1, high + max(1, high // 64)
    while high - low > max(1, high // 20000):
        middle = (low + high) // 2
        trial = best_fit_decreasing(sizes, middle)
        if max(trial, default=0) < shards:
            plan, high = trial, middle
        else:
            low = middle + 1
    return plan


def _crates(groups: DataFrame, capacity: int) -> DataFrame:
    """(content, crate, bytes) for groups that arrive sorted by falling size in each partition."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(capacity)
        base = TaskContext.get().partitionId() << 32
        for batch in batches:
            crate = np.fromiter((base + bins.add(s) for s in batch.column(1).to_pylist()), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crate), batch.column(1)], names=["content", "crate", "bytes"])

    return groups.mapInArrow(rows, "content binary, crate long, bytes long")


def shard_documents(
    docs: DataFrame, shards: int = 24, *, crates_per_shard: int = 256, overhead: int = 8, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row; sizes of shards near equal, equal texts together."""
    spark = docs.sparkSession
    parts = shared.shuffle_parts(spark)
    text = F.coalesce(docs[text_column], F.lit(""))
    slim = shared.written(
        docs.select(
            docs[id_column].cast("long").alias("doc_id"),
            (F.octet_length(text).cast("long") + overhead).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.sha2(text, 256)).alias("content"),
        ),
        "shard-rows",
    )
    groups = slim.groupBy("content").agg(F.sum("size").alias("bytes"))
    total = slim.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    capacity = max(1, total // (shards * crates_per_shard))
    crates = shared.written(_crates(groups.repartition(parts, "content").sortWithinPartitions(F.desc("bytes"), "content"), capacity), "shard-crates")
    sums = crates.groupBy("crate").agg(F.sum("bytes").alias("bytes")).orderBy("crate").collect()
    plan = pack_into([r.bytes for r in sums], shards)
    shard_of = spark.createDataFrame([(r.crate, s) for r, s in zip(sums, plan)], "crate long, shard int")
    placed = crates.join(F.broadcast(shard_of), "crate").select("content", "shard")
    placed = shared.written(
        shared.lookup(slim, placed, "content").select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)).alias("part")), "shard-placed"
    )
    counts = placed.groupBy("shard", "part").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "part", before.alias("before"))
    nth = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32")) - 1
    return placed.withColumn("nth", nth).join(F.broadcast(offsets), ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("nth")).alias("slot"))
