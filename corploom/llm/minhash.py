"""Near-duplicate documents: universal hash minima, banding, verification, components.

1. One narrow pass hashes every document's distinct word shingles and takes the
   minima of many universal hashes ``a * x + b mod 2**64``.  It writes, per
   document, a 128-bit digest of the set, one key a band and one byte a minimum.
2. Documents with equal sets collapse onto the smallest id.
3. Each band bucket with more than one document links its smallest id (the
   centre) to the others: a star, never all pairs.
4. A star edge is first held against the signatures: a pair at the threshold
   falls below the bound used with a probability of about 1e-12.  What is left
   is confirmed on the full sets, recomputed from the texts.
5. Confirmed links go through large-star and small-star.
6. Buckets whose other members now lie in different components may still hide
   links between two non-centres.  Only for those, members outside of a bucket's
   most frequent component meet the rest in blocks of bounded size, by signature
   first and full sets after, and components run again.  So every link between documents that share a band is found.

With 50 bands of 6 rows a pair at similarity 0.8 shares no band with a
probability of 3e-7.

Cases: a null text or one without words has the empty set and is linked with
nothing; a text with fewer words than a shingle is one shingle; repeated rows
and equal texts share a component; of ties the least id leads; a very long text
is shingled whole, in memory of about a hundred times its bytes; rows with a null
id keep a null component; an empty table gives an empty result; other columns
are not read here and pass through `drop_near_duplicates` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corploom.llm import blocks, shared
from corploom.llm.components import components

U64 = np.uint64
#: Joins between tables that grow with the documents all shuffle, on any amount of data: a plan that broadcasts
#: the small cases tells nothing about the large ones.
_BOTH_GROW = "merge"
_FAN = 256  # edges of one node, or members of one bucket, that meet in one group
_WIDE = 2048  # members of one bucket that those meet there


@dataclass(frozen=True)
class NearParameters:
    words: int = 5
    percent: int = 80
    bands: int = 50
    rows: int = 6
    seed: int = 1

    @property
    def hashes(self) -> int:
        return self.bands * self.rows

    @property
    def least_matches(self) -> int:
        """Equal minima below which a pair at the threshold practically never falls (seven deviations)."""
        p = self.percent / 100
        return int(self.hashes * p - 7 * (self.hashes * p * (1 - p)) ** 0.5)

    def multipliers(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        a, b = rng.integers(0, 1 << 63, (2, self.hashes), dtype=np.uint64)
        return a * U64(2) + U64(1), b * U64(2)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each row, rows one after another, and the row offsets."""
    words = blocks.split_words(blocks.LOWER[data], offsets)
    hashes = words.hashes()
    starts, keys = blocks.window_hashes(hashes, words.rows, size)
    row = words.row_of_word()[starts]
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        whole = np.zeros(len(short), U64)
        for k in range(size - 1):
            has = words.counts[short] > k
            whole[has] = whole[has] * U64(0x8CB92BA72F3D8DD7) + hashes[words.rows[short[has]] + k]
        keys = np.concatenate([keys, blocks.mix64(whole + words.counts[short].astype(U64))])
        row = np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        keys, row = keys[order], row[order]
    salted = blocks.salt_by_row(keys, row)
    order = np.argsort(salted, kind="stable")
    ordered = salted[order]
    first = np.ones(len(keys), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    keep = np.zeros(len(keys), bool)
    keep[order[first]] = True
    keys, row = keys[keep], row[keep]
    return keys, np.searchsorted(row, np.arange(len(offsets)))


SCAN = "doc_id long, n_shingles long, digest binary, bands array<long>, signature binary"


def _scan_rows(doc_ids: pa.Array, data: np.ndarray, offsets: np.ndarray, p: NearParameters) -> pa.RecordBatch:
    keys, at = shingle_sets(data, offsets, p.words)
    n_rows, counts = len(offsets) - 1, np.diff(at)
    full = np.flatnonzero(counts)
    begins = at[full]
    digest = np.zeros((n_rows, 2), U64)
    minima = np.empty((p.hashes, len(full)), U64)
    if len(full):
        for k, salt in enumerate((0x2545F4914F6CDD1D, 0x9E6C63D0876A9A35)):
            digest[full, k] = np.add.reduceat(blocks.mix64(keys ^ U64(salt)), begins)
        value = np.empty_like(keys)
        for k, (a, b) in enumerate(zip(*p.multipliers())):
            np.multiply(keys, a, out=value)
            np.add(value, b, out=value)
            np.minimum.reduceat(value, begins, out=minima[k])
    bands = np.zeros((len(full), p.bands), U64)
    for band in range(p.bands):
        acc = np.full(len(full), (band + 1) * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF, U64)
        for k in range(p.rows):
            acc = blocks.mix64(acc + minima[band * p.rows + k])
        bands[:, band] = acc
    signature = (blocks.mix64(minima) & U64(0xFF)).astype(np.uint8).T.copy()
    list_at = np.concatenate([[0], np.cumsum((counts > 0) * p.bands)]).astype(np.int32)
    blob_at = np.concatenate([[0], np.cumsum((counts > 0) * p.hashes)]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [
            doc_ids,
            pa.array(counts.astype(np.int64)),
            pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), n_rows, [None, pa.py_buffer(digest)]).cast(pa.binary()),
            pa.ListArray.from_arrays(pa.array(list_at), pa.array(bands.ravel().view(np.int64))),
            pa.BinaryArray.from_buffers(pa.binary(), n_rows, [None, pa.py_buffer(blob_at), pa.py_buffer(signature)]),
        ],
        names=["doc_id", "n_shingles", "digest", "bands", "signature"],
    )


def scan(docs: DataFrame, p: NearParameters) -> DataFrame:
    """Set size, set digest, band keys and signature of each (doc_id, text)."""

    @blocks.tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets, _ = blocks.utf8(batch.column(1))
            for i, j in blocks.row_slices(offsets):
                yield _scan_rows(batch.column(0).slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], p)

    return docs.mapInArrow(rows, SCAN)


def _packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, packed): texts compressed before they shuffle."""

    @blocks.tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            texts = batch.column(1).fill_null("").cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(t.as_buffer()) for t in texts], pa.binary())], names=["doc_id", "packed"])

    return docs.mapInArrow(rows, "doc_id long, packed binary")


def _attach(edges: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Edges (a, b) with the columns of both ends, as ``a_<column>`` and ``b_<column>``.

    The ``a`` side is copied once for every `_FAN` of its edges, and a salt from
    ``b`` spreads them, so a node with any number of edges makes no hot key.
    """
    fans = edges.groupBy("a").agg(F.ceil(F.count("*") / _FAN).cast("int").alias("fan"))
    left = table.select(F.col("doc_id").alias("a"), *(F.col(c).alias(f"a_{c}") for c in columns)).join(fans.hint(_BOTH_GROW), "a")
    left = left.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)))
    right = edges.join(fans.hint(_BOTH_GROW), "a").withColumn("salt", F.pmod(F.hash("b"), F.col("fan"))).select("a", "b", "salt")
    right = right.hint(_BOTH_GROW).join(table.select(F.col("doc_id").alias("b"), *(F.col(c).alias(f"b_{c}") for c in columns)), "b")
    return left.drop("fan").join(right.hint(_BOTH_GROW), ["a", "salt"]).drop("salt")


def _by_signature(edges: DataFrame, signatures: DataFrame, p: NearParameters) -> DataFrame:
    """Edges whose signatures and set sizes allow the threshold."""
    both = _attach(edges, signatures, ["signature", "n_shingles"])
    both = both.where((F.least("a_n_shingles", "b_n_shingles") * 100 >= F.greatest("a_n_shingles", "b_n_shingles") * p.percent))

    @blocks.tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (blocks.utf8(batch.column(k))[0].reshape(batch.num_rows, p.hashes) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).sum(axis=1) >= p.least_matches))

    return both.select("a", "b", "a_signature", "b_signature").mapInArrow(rows, "a long, b long")


def _by_sets(edges: DataFrame, texts: DataFrame, p: NearParameters) -> DataFrame:
    """Edges confirmed on the full shingle sets of both texts."""

    @blocks.tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        last: tuple[bytes, np.ndarray] = (b"", np.zeros(0, U64))

        def sets(packed: list[bytes]) -> list[np.ndarray]:
            raw = [unpack(x) for x in packed]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
            keys, at = shingle_sets(np.frombuffer(b"".join(raw), np.uint8), offsets, p.words)
            return [np.sort(keys[at[k] : at[k + 1]]) for k in range(len(raw))]

        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            step = 64
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                ours = sets(part.column(3).to_pylist())
                for k, (left, right) in enumerate(zip(part.column(2).to_pylist(), ours)):
                    if left != last[0]:
                        last = (left, sets([left])[0])
                    both = len(np.intersect1d(last[1], right, assume_unique=True))
                    keep[i + k] = 100 * both >= p.percent * (len(last[1]) + len(right) - both)
            yield batch.select([0, 1]).filter(pa.array(keep))

    return _attach(edges, texts, ["packed"]).select("a", "b", "a_packed", "b_packed").mapInArrow(rows, "a long, b long")


def _blocks_of_buckets(members: DataFrame, signatures: DataFrame, p: NearParameters) -> DataFrame:
    """Pairs (a, b) of different labels in one bucket that their signatures allow.

    Members (key, doc, label) of a bucket meet only those of other labels: its
    members outside of the most frequent label, in chunks of about `_FAN`, meet
    all of them, in chunks of about `_WIDE`.  A bucket is copied once for every
    `_FAN` of its minority, so one stray member among a million costs a million
    comparisons; every group is bounded however large the bucket is.
    """
    sizes = members.groupBy("key", "label").count().groupBy("key").agg(F.max(F.struct("count", "label")).alias("most"), F.sum("count").alias("size"))
    chunks, parts = F.ceil((F.col("size") - F.col("most.count")) / _FAN), F.ceil(F.col("size") / _WIDE)
    sizes = sizes.select("key", F.col("most.label").alias("major"), chunks.cast("int").alias("chunks"), parts.cast("int").alias("parts"))
    sized = shared.lookup(members, sizes, "key")
    minor = F.col("label") != F.col("major")
    chunk, part = F.pmod(F.xxhash64("doc"), "chunks").cast("int"), F.pmod(F.xxhash64("doc", F.lit(1)), "parts").cast("int")
    left = sized.where(minor).select("key", "doc", "label", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("side"))
    right = sized.select(
        "key", "doc", "label", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), part.alias("part"), F.when(minor, F.lit(2)).otherwise(F.lit(3)).alias("side")
    )
    met = left.union(right).join(signatures.select(F.col("doc_id").alias("doc"), "signature", "n_shingles"), "doc")
    met = met.select("key", "chunk", "part", "doc", "label", "side", "signature", "n_shingles")

    def pairs(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        doc, label, side, size = (group.column(k).to_numpy() for k in ("doc", "label", "side", "n_shingles"))
        marks = blocks.utf8(group.column("signature"))[0].reshape(len(doc), p.hashes)
        found = [np.zeros((0, 2), np.int64)]
        other = np.flatnonzero(side > 1)
        for i in np.flatnonzero(side == 1):
            # Two members outside of the majority meet twice; the smaller one leads.
            can = (label[other] != label[i]) & ((side[other] == 3) | (doc[other] > doc[i]))
            at = other[can & (100 * np.minimum(size[other], size[i]) >= p.percent * np.maximum(size[other], size[i]))]
            at = at[(marks[at] == marks[i]).sum(axis=1) >= p.least_matches]
            found.append(np.stack([np.minimum(doc[at], doc[i]), np.maximum(doc[at], doc[i])], axis=1))
        both = np.concatenate(found)
        return pa.table({"a": both[:, 0].copy(), "b": both[:, 1].copy()})

    return met.groupBy("key", "chunk", "part").applyInArrow(pairs, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, p: NearParameters | None = None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the least id reachable over links) of every row."""
    p = p or NearParameters()
    shared.bound_batches(docs.sparkSession)
    slim = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    scanned = shared.written(scan(slim, p), "near-scan")
    some = scanned.where("n_shingles > 0")
    sets = some.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    reps = shared.written(shared.lookup(some.select("doc_id", "digest"), sets, "digest").select("doc_id", "rep").distinct(), "near-reps")

    band = some.select("doc_id", F.explode("bands").alias("key"))
    buckets = shared.written(band.groupBy("key").agg(F.min("doc_id").alias("centre"), F.count("*").alias("size")).where("size > 1 and centre is not null"), "near-buckets")
    limit = max(scanned.count() // (4 * shared.shuffle_parts(docs.sparkSession)), 1000)
    hot = F.broadcast(buckets.where(F.col("size") > limit))  # at most `bands` x 4 P of all keys
    cold = band.join(buckets.where(F.col("size") <= limit).hint(_BOTH_GROW), "key")
    members = cold.unionByName(band.join(hot, "key")).where("doc_id is not null and doc_id != centre")
    members = shared.written(members.select("key", "centre", "size", "doc_id").join(reps, "doc_id").select("key", "centre", "size", F.col("rep").alias("doc")).where("doc != centre").distinct(), "near-members")

    star = shared.written(members.select(F.col("centre").alias("a"), F.col("doc").alias("b")).distinct(), "near-star")
    wanted = star.select("a").union(star.select("b")).distinct().withColumnRenamed("a", "doc_id")
    signatures = some.select("doc_id", "n_shingles", "signature").join(wanted.hint(_BOTH_GROW), "doc_id", "left_semi")
    texts = shared.written(_packed_texts(slim).join(wanted.hint(_BOTH_GROW), "doc_id", "left_semi"), "near-texts")
    links = shared.written(_by_sets(_by_signature(star, signatures, p), texts, p).distinct(), "near-links")
    labels = shared.written(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "near-labels")

    def labelled(rows: DataFrame, column: str) -> DataFrame:
        return rows.join(labels.withColumnRenamed("node", column), column, "left").withColumn("label", F.coalesce("label", column))

    rest = labelled(members.where("size > 2").select("key", "doc"), "doc")
    torn = rest.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("key")
    hidden = shared.written(rest.join(torn, "key", "left_semi"), "near-hidden")
    more = shared.written(_blocks_of_buckets(hidden, signatures, p), "near-pairs")
    if not more.isEmpty():
        found = _by_sets(more, texts, p)
        edges = labels.select(F.col("node").alias("u"), F.col("label").alias("v")).union(found)
        labels = shared.written(components(edges), "near-labels")
    for table in (buckets, members, star, texts, links, hidden, more):
        shared.forget(table)
    whole = shared.lookup(reps, labels_or_self(reps, labels), "rep")
    return scanned.select("doc_id", "n_shingles").join(_by_id(whole), "doc_id", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("label")).otherwise(F.col("doc_id")).alias("component_id")
    )


def labels_or_self(reps: DataFrame, labels: DataFrame) -> DataFrame:
    """(rep, label) of every representative, its own where no link reaches it."""
    return reps.select("rep").distinct().join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def _by_id(whole: DataFrame) -> DataFrame:
    return whole.groupBy("doc_id").agg(F.min("label").alias("label"))


_NODE, _CONTENT, _PART, _AT = "__near_node", "__near_content", "__near_part", "__near_at"
_ROW_BITS = 33  # of monotonically_increasing_id, below the partition


def _with_nodes(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """One row of each (id, text) with a number of its own, in the order of ids, null ones last."""
    spark = docs.sparkSession
    content = F.coalesce(F.sha2(docs[text_column], 256), F.lit("null")).alias(_CONTENT)
    known = shared.written(docs.select(docs[id_column].cast("long").alias("id"), content).distinct(), "near-known")
    order = [F.col("id").isNull(), F.col("id"), F.col(_CONTENT)]
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias(_AT)
    ranged = known.repartitionByRange(shared.shuffle_parts(spark), *order).sortWithinPartitions(*order)
    ranged = shared.written(ranged.select("*", F.spark_partition_id().alias(_PART), at), "near-ranged")
    before = F.coalesce(F.sum("n").over(Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranged.groupBy(_PART).agg(F.count("*").alias("n")).select(_PART, before.alias("before"))  # a row a partition
    nodes = ranged.join(F.broadcast(offsets), _PART).select("id", F.col(_CONTENT).alias("content"), (F.col("before") + F.col(_AT)).alias(_NODE))
    keyed = docs.select("*", content)
    met = keyed.join(nodes.hint(_BOTH_GROW), (keyed[_CONTENT] == nodes["content"]) & keyed[id_column].cast("long").eqNullSafe(nodes["id"]))
    return shared.written(met.select(*(keyed[c] for c in docs.columns), _NODE).dropDuplicates([_NODE]), "near-rows")


def drop_near_duplicates(
    docs: DataFrame, p: NearParameters | None = None, *, id_column: str = "doc_id", text_column: str = "text", broadcast_ids: int = 2_000_000
) -> DataFrame:
    """One document of each component, that with the least id, with all its columns.

    Where ids are distinct no text moves on their account, but for more than
    `broadcast_ids` documents to drop.  Where some are repeated or null, rows
    count as one document if they agree in id and text, and then stay once; rows
    with one id and other texts, or with no id, are documents of their own.
    """
    if not docs.groupBy(docs[id_column]).count().where((F.col("count") > 1) | F.col(id_column).isNull()).isEmpty():
        names, docs, id_column = docs.columns, _with_nodes(docs, id_column, text_column), _NODE
    else:
        names = docs.columns
    found = near_duplicates(docs, p, id_column=id_column, text_column=text_column)
    gone = shared.written(found.where("doc_id != component_id").select(F.col("doc_id").alias(id_column)), "near-gone")
    few = gone.count() <= broadcast_ids
    return docs.join(F.broadcast(gone) if few else gone.hint(_BOTH_GROW), id_column, "left_anti").select(*names)
