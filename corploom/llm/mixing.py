"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

Documents of a source, in id order, form blocks.  With integer weights w_i that
sum to H (about `ticks`), block j of source i (from 0) has the release time
``floor(j H / w_i)`` and the deadline ``ceil((j + 1) H / w_i)``.  Earliest
deadline first among released blocks meets every deadline on one processor at
full use, so after any number of slots each source is less than one block from
its share, which is w_i / H: the target rounded to about 1 / `ticks`.  The
schedule repeats every H slots: one fold (`pyspark.sql.functions.aggregate`)
over the blocks released at each slot plans a period, with the waiting blocks in
an array from which the earliest goes; block j then takes slot
``(j div w_i) H + position[j mod w_i]``.

No document is dropped.  Where a source runs out, its slots stay empty and the
others keep their proportions; `on_target` marks the slots before that.

The rows are read once for slim rows of ids and sources.  Those are sorted by
range into parts of at most about `rows_per_range` rows, whatever share of them
a source has; a row's rank in its source is its place in its part plus the rows
of the source in earlier parts.  Only counts by source and part, and the plan of
a period, are broadcast, and only up to `broadcast_rows`; beyond, they shuffle.
`interleave` reads the rows a second time and moves them twice: to their slots,
and to the range of slots that is their file.

Cases: null sources are one source of their own; texts are not read by
`mix_sources`; null ids come first; rows with one id are ranked next to each
other in any order, and rows alike in all columns are equal; an empty table
gives an empty result; `interleave` keeps all columns, whatever their names, and
the ones it works with start with ``__mix``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corploom.llm import shared


@dataclass(frozen=True)
class MixParameters:
    """Weights by source (None for null ones): any positive numbers, of which only the ratios count.

    Sources without a weight, or all, get the square root of their number of
    documents, on the scale on which the weighted sources have their weights.
    """

    weights: dict[str | None, float] | None = None
    block_docs: int = 16
    ticks: int = 1000
    rows_per_range: int = 1_000_000
    rows_per_file: int = 50_000
    broadcast_rows: int = 1_000_000

    def __post_init__(self) -> None:
        for source, weight in (self.weights or {}).items():
            if not (isinstance(weight, (int, float)) and math.isfinite(weight) and weight > 0):
                raise ValueError(f"the weight of {source!r} is {weight!r}: weights are finite numbers above zero")

    def scores(self) -> dict[str, int]:
        """The given weights by key, as integers that sum to about a thousand million."""
        total = math.fsum((self.weights or {}).values())
        return {"n" if k is None else f"s{k}": max(1, round(w / total * 10**9)) for k, w in (self.weights or {}).items()}


_ALL_BEFORE = (Window.unboundedPreceding, -1)
_KEY, _ID, _TIES = "__mix_key", "__mix_id", ["__mix_tie0", "__mix_tie1"]
_ROW_BITS = 33  # of monotonically_increasing_id, below the partition


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _wanted(counts: DataFrame, p: MixParameters) -> DataFrame:
    """Integer weight `w` of each source: its share of about `ticks`, rounded, one at least."""
    root = F.sqrt(F.col("n").cast("double"))
    one = Window.partitionBy(F.lit(1))  # one row a source
    score = F.floor(root * 1000).cast("long")
    given = p.scores()
    if given:
        own = F.create_map(*(x for k, v in given.items() for x in (F.lit(k), F.lit(v).cast("long"))))[F.col("key")]
        scale = F.sum(own).over(one) / F.sum(F.when(own.isNotNull(), root)).over(one)
        score = F.coalesce(own, F.greatest(F.lit(1), F.round(root * scale)).cast("long"), score)
    scored = counts.withColumn("score", score).withColumn("all", F.sum("score").over(one))
    return scored.select("key", "n", F.greatest(F.lit(1), F.expr(f"(2 * {p.ticks} * cast(score as decimal(20, 0)) + all) div (2 * all)").cast("long")).alias("w"))


def _bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _period(wanted: DataFrame, slots: int) -> DataFrame:
    """One period of the schedule: key, n, w, r (which of the source's blocks) and pos (its slot).

    A slot costs one pass over the blocks that wait, at most one a source.
    """
    nth = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("key")) - 1  # one row a source
    sources = wanted.withColumn("i", nth.cast("long")).withColumn("k", F.count("*").over(Window.partitionBy(F.lit(1))))
    jobs = sources.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") - 1)))
    due = F.expr(f"((r + 1) * {slots} + w - 1) div w")
    jobs = jobs.select("key", "n", "w", "i", "k", "r", F.expr(f"r * {slots} div w").alias("t"), (due * F.col("k") + F.col("i")).alias("code"))
    released = wanted.sparkSession.range(slots).withColumnRenamed("id", "t").join(jobs.groupBy("t").agg(F.collect_list("code").alias("codes")), "t", "left")
    none = F.array().cast("array<long>")
    every = released.agg(F.sort_array(F.collect_list(F.struct("t", F.coalesce("codes", none).alias("codes")))).alias("every"))

    def step(state: Column, x: Column) -> Column:
        def taken(waiting: Column) -> Column:
            return _bound(
                F.array_min(waiting), lambda first: F.struct(F.array_remove(waiting, first).alias("waiting"), F.concat(state["order"], F.array(first)).alias("order"))
            )

        return _bound(F.concat(state["waiting"], x["codes"]), taken)

    start = F.struct(none.alias("waiting"), none.alias("order"))
    order = every.select(F.posexplode(F.aggregate("every", start, step, lambda x: x["order"])).alias("pos", "code"))
    return order.join(jobs, "code").select("key", "n", "w", "r", F.col("pos").cast("long").alias("pos"))


def _fits(rows: int, table: DataFrame, p: MixParameters) -> DataFrame:
    """A table with the hint to broadcast it, if its counted rows are few enough."""
    return F.broadcast(table) if rows <= p.broadcast_rows else table.hint("merge")


def _schedule(slim: DataFrame, p: MixParameters) -> DataFrame:
    """All columns of slim rows (with key, id and tie columns), and __mix_block, _place, _release, _deadline, _slot and _on_target."""
    slim = shared.written(slim, "mix-rows")
    total = slim.count()
    order = [_KEY, _ID, *(t for t in _TIES if t in slim.columns)]
    parts = slim.repartitionByRange(max(1, -(-total // p.rows_per_range)), *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    parts = shared.written(parts.select("*", F.spark_partition_id().alias("__mix_part"), at.alias("__mix_at")), "mix-parts")
    shared.forget(slim)

    cells = parts.groupBy(_KEY, "__mix_part").agg(F.count("*").alias("__mix_n"), F.min("__mix_at").alias("__mix_first"))
    before = F.coalesce(F.sum("__mix_n").over(Window.partitionBy(_KEY).orderBy("__mix_part").rowsBetween(*_ALL_BEFORE)), F.lit(0))
    cells = shared.written(cells.withColumn("__mix_before", before), "mix-cells")
    counts = cells.groupBy(F.col(_KEY).alias("key")).agg(F.sum("__mix_n").alias("n"))
    n_sources = counts.count()
    p = MixParameters(p.weights, p.block_docs, max(p.ticks, 2 * n_sources), p.rows_per_range, p.rows_per_file, p.broadcast_rows)
    wanted = shared.written(_wanted(counts, p), "mix-weights")
    slots = wanted.agg(F.sum("w")).first()[0] or 0
    period = shared.written(_period(wanted, slots), "mix-period")

    blocks = f"((n + {p.block_docs - 1}) div {p.block_docs})"
    lacking = period.where(f"r = {blocks} % w").agg(F.min(F.expr(f"({blocks} div w) * {slots} + pos"))).first()[0]

    cells = cells.drop("__mix_n").join(wanted.select(F.col("key").alias(_KEY), F.col("w").alias("__mix_w")), _KEY)
    ranked = parts.join(_fits(total // p.rows_per_range + 1 + n_sources, cells, p), [_KEY, "__mix_part"])
    ranked = ranked.withColumn("__mix_rank", F.col("__mix_before") + F.col("__mix_at") - F.col("__mix_first"))
    ranked = ranked.withColumn("__mix_block", F.expr(f"__mix_rank div {p.block_docs}")).withColumn("__mix_place", F.expr(f"cast(__mix_rank % {p.block_docs} as int)"))
    plan = period.select(F.col("key").alias(_KEY), F.col("r").alias("__mix_r"), F.col("pos").alias("__mix_pos"))
    ranked = ranked.withColumn("__mix_r", F.expr("__mix_block % __mix_w")).join(_fits(slots, plan, p), [_KEY, "__mix_r"])
    return (
        ranked.withColumn("__mix_release", F.expr(f"__mix_block * {slots} div __mix_w"))
        .withColumn("__mix_deadline", F.expr(f"((__mix_block + 1) * {slots} + __mix_w - 1) div __mix_w"))
        .withColumn("__mix_slot", F.expr(f"(__mix_block div __mix_w) * {slots} + __mix_pos"))
        .withColumn("__mix_on_target", F.col("__mix_slot") < F.lit(lacking).cast("long"))
    )


def mix_sources(docs: DataFrame, p: MixParameters | None = None, *, id_column: str = "doc_id", source_column: str = "source") -> DataFrame:
    """doc_id, source, block, place in the block, release, deadline, slot and on_target of every row."""
    source = docs[source_column]
    # The tie is written before anything is sorted by it, so rows without ids spread over parts and stay where they are.
    tie = F.xxhash64(F.monotonically_increasing_id()).alias(_TIES[0])
    slim = docs.select(_key(source).alias(_KEY), docs[id_column].alias(_ID), source.alias("source"), tie)
    out = _schedule(slim, p or MixParameters())
    return out.select(F.col(_ID).alias("doc_id"), "source", *(F.col(f"__mix_{k}").alias(k) for k in ("block", "place", "release", "deadline", "slot", "on_target")))


def interleave(docs: DataFrame, p: MixParameters | None = None, *, id_column: str = "doc_id", source_column: str = "source") -> DataFrame:
    """All rows and columns in the order of their slots: the order of the files and of the rows in them when written."""
    p = p or MixParameters()
    hashed = [docs[f.name] for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    ties = [F.xxhash64(*hashed).alias(_TIES[0]), F.xxhash64(F.lit(1), *hashed).alias(_TIES[1])]
    keyed = docs.select("*", docs[id_column].alias(_ID), *ties)
    slim = keyed.select(_key(docs[source_column]).alias(_KEY), _ID, *_TIES)
    slots = shared.written(_schedule(slim, p).select(_ID, *_TIES, "__mix_slot", "__mix_place"), "mix-slots")
    found = slots.agg(F.count("*").alias("rows"), F.coalesce(F.max("__mix_slot"), F.lit(0)).alias("last")).first()
    if not slots.groupBy(_ID, *_TIES).count().where("count > 1").isEmpty():
        keyed = keyed.dropDuplicates([_ID, *_TIES])  # one of rows that are alike gives the rows of all their slots
    same = [*(keyed[c] == slots[c] for c in _TIES), keyed[_ID].eqNullSafe(slots[_ID])]
    placed = keyed.join(slots.hint("merge"), same).select(*(keyed[c] for c in docs.columns), "__mix_slot", "__mix_place")
    rows = max(1, min(p.rows_per_file, -(-found.rows // shared.shuffle_parts(docs.sparkSession))))
    span = max(1, rows // p.block_docs)  # slots of a file: it never holds more than `rows` documents and a block
    files = placed.repartitionById(found.last // span + 1, F.expr(f"cast(__mix_slot div {span} as int)"))
    return files.sortWithinPartitions("__mix_slot", "__mix_place").select(*docs.columns)
