"""Exact deduplication with counting quotient filters.

Every partition builds a counting quotient filter over the 64-bit fingerprints
of its documents. The filters are cut by their leading quotient bits, and one
task per range merges the pieces by their sorted remainders, which loses
nothing: the merged filter is what one filter over all rows would hold.
Fingerprints with a count above one go to byte verification, where documents
are grouped by the normalised text itself, with partial aggregation before the
shuffle, so that a group with a third of all rows arrives as one row a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import SPACE, lean, materialise

REMAINDER_BITS = 40
#: Rows that a range of leading bits has on average, at most.
RANGE_ROWS = 500_000


class QuotientFilter:
    """A counting quotient filter in the layout of sorted runs.

    A fingerprint's high bits are its quotient, the low `r` bits its remainder.
    `occupied` has a bit for each quotient with a run, `runend` a bit for each
    slot that ends its run, `remainders` the slots in order, and `counts` the
    multiplicity of each slot. The pair of bit vectors restores the quotient of
    every slot, so fingerprints are never stored whole.
    """

    def __init__(self, occupied: np.ndarray, runend: np.ndarray, remainders: np.ndarray, counts: np.ndarray, low: int, r: int = REMAINDER_BITS):
        self.occupied, self.runend, self.remainders, self.counts, self.low, self.r = occupied, runend, remainders, counts, low, r

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None, r: int = REMAINDER_BITS) -> QuotientFilter:
        """From unsigned 64-bit fingerprints in any order, repeated or not."""
        fingerprints = np.asarray(fingerprints, np.uint64)
        counts = np.ones(len(fingerprints), np.int64) if counts is None else np.asarray(counts, np.int64)
        order = np.argsort(fingerprints, kind="stable")
        return cls._of_sorted(fingerprints[order], counts[order], r)

    @classmethod
    def _of_sorted(cls, fingerprints: np.ndarray, counts: np.ndarray, r: int) -> QuotientFilter:
        if not len(fingerprints):
            return cls(np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, r)
        first = np.flatnonzero(np.r_[True, fingerprints[1:] != fingerprints[:-1]])
        slots, summed = fingerprints[first], np.add.reduceat(counts, first)
        quotients = slots >> np.uint64(r)
        low = int(quotients[0])
        occupied = np.zeros(int(quotients[-1]) - low + 1, bool)
        occupied[(quotients - np.uint64(low)).astype(np.int64)] = True
        runend = np.r_[quotients[1:] != quotients[:-1], True]
        return cls(occupied, runend, slots & np.uint64((1 << r) - 1), summed, low, r)

    def fingerprints(self) -> np.ndarray:
        """All distinct fingerprints in ascending order."""
        quotients = np.flatnonzero(self.occupied).astype(np.uint64) + np.uint64(self.low)
        run = np.r_[0, np.cumsum(self.runend)[:-1]].astype(np.int64) if len(self.runend) else np.zeros(0, np.int64)
        return (quotients[run] << np.uint64(self.r)) | self.remainders if len(run) else np.zeros(0, np.uint64)

    def merge(self, other: QuotientFilter) -> QuotientFilter:
        """The filter of both inputs' rows together, in one pass over the sorted slots: counts of equal slots add up."""
        a, b = self.fingerprints(), other.fingerprints()
        both, counts = np.empty(len(a) + len(b), np.uint64), np.empty(len(a) + len(b), np.int64)
        for own, rest, n, side in ((a, b, self.counts, "left"), (b, a, other.counts, "right")):
            place = np.arange(len(own)) + np.searchsorted(rest, own, side)
            both[place], counts[place] = own, n
        return QuotientFilter._of_sorted(both, counts, self.r)

    def to_bytes(self) -> bytes:
        head = np.array([self.r, self.low, len(self.occupied), len(self.remainders)], np.int64).tobytes()
        low32, high = (self.remainders & np.uint64(0xFFFFFFFF)).astype(np.uint32), (self.remainders >> np.uint64(32)).astype(np.uint32)
        return head + np.packbits(self.occupied).tobytes() + np.packbits(self.runend).tobytes() + low32.tobytes() + high.tobytes() + self.counts.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> QuotientFilter:
        r, low, n_occupied, n = (int(x) for x in np.frombuffer(data, np.int64, 4))
        at = 32
        occupied = np.unpackbits(np.frombuffer(data, np.uint8, -(-n_occupied // 8), at), count=n_occupied).astype(bool)
        at += -(-n_occupied // 8)
        runend = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n).astype(bool)
        at += -(-n // 8)
        low32 = np.frombuffer(data, np.uint32, n, at).astype(np.uint64)
        high = np.frombuffer(data, np.uint32, n, at + 4 * n).astype(np.uint64)
        return cls(occupied, runend, low32 | (high << np.uint64(32)), np.frombuffer(data, np.int64, n, at + 8 * n), low, r)


def normalised(text: Column) -> Column:
    """A text without the six white-space characters; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def _partition_filter(range_bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting = None, []

        def fold():
            nonlocal parts, waiting
            filters = [QuotientFilter.build(np.concatenate(waiting))] + ([parts] if parts else [])
            parts, waiting = (filters[0].merge(filters[1]) if len(filters) == 2 else filters[0]), []

        for batch in batches:
            waiting.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, waiting)) > 1_000_000:
                fold()
        if waiting:
            fold()
        if parts is None or not len(parts.counts):
            return
        prints = parts.fingerprints()
        ranges = (prints >> np.uint64(64 - range_bits)).astype(np.int64)
        cuts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]])
        blocks = [QuotientFilter.build(p, c).to_bytes() for p, c in zip(np.split(prints, cuts[1:]), np.split(parts.counts, cuts[1:]), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ranges[cuts], pa.int64()), pa.array(blocks, pa.binary())], ["range", "block"])

    return build


def merged_filters(fingerprints: DataFrame, range_bits: int) -> DataFrame:
    """One row per range of leading bits: (range, block), the merged filter of all partitions.

    `fingerprints` has one bigint column. A task holds one range, whose size
    falls with 2^range_bits; equal fingerprints take one slot however many.
    """

    def merge(key, pdf):
        filters = [QuotientFilter.from_bytes(b) for b in pdf["block"]]
        while len(filters) > 1:  # in pairs, so that no slot is moved more often than the logarithm of their number
            filters = [f[0].merge(f[1]) if len(f) == 2 else f[0] for f in (filters[k : k + 2] for k in range(0, len(filters), 2))]
        return pdf.iloc[:1].assign(block=[filters[0].to_bytes()])

    pieces = fingerprints.mapInArrow(lean(_partition_filter(range_bits)), "range long, block binary")
    return pieces.groupBy("range").applyInPandas(merge, "range long, block binary")


def repeated_fingerprints(filters: DataFrame) -> DataFrame:
    """The fingerprints (fp bigint) that the merged filters count more than once."""

    def read(batches):
        for batch in batches:
            for block in batch.column(0).to_pylist():
                f = QuotientFilter.from_bytes(block)
                yield pa.RecordBatch.from_arrays([pa.array(f.fingerprints()[f.counts > 1].view(np.int64), pa.int64())], ["fp"])

    return filters.select("block").mapInArrow(lean(read), "fp long")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bits: int | None = None) -> DataFrame:
    """Groups of documents whose texts are equal without white space.

    Returns one row per input row: doc_id, keep_id, group_size, kept,
    text_sha256. Of a group, the row with the most code points, then the
    smallest id stays. Null texts are empty texts, which equal each other. Null
    ids come after all others; a group without ids has keep_id null. Of repeated
    rows (same id, same normalised text) exactly one is kept. An empty table
    gives an empty result. Other columns of `docs` are not read.

    `range_bits`: the merge works on 2^range_bits ranges; by default as many as
    leave about RANGE_ROWS rows to each.
    """
    if range_bits is None:
        range_bits = max(6, (docs.count() // RANGE_ROWS).bit_length())
    text = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("chars"))
    keyed = text.withColumn("fp", F.xxhash64("norm"))
    heavy = materialise(repeated_fingerprints(merged_filters(keyed.select("fp"), range_bits)), "repeated-fingerprints")
    best = F.max_by("doc_id", F.struct("chars", (-F.col("doc_id")).alias("low")))
    groups = (
        keyed.join(heavy, "fp", "left_semi")
        .groupBy("fp", "norm")
        .agg(best.alias("keep_id"), F.count("*").alias("group_size"))
        .select(F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    # rows of one text are numbered within their id, before the join brings the text's whole group together
    once = Window.partitionBy("text_sha256", "doc_id").orderBy(F.col("chars").desc())
    rows = text.select("doc_id", "chars", F.sha2("norm", 256).alias("text_sha256")).withColumn("n", F.row_number().over(once))
    keep_id = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.join(groups, "text_sha256", "left").select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep_id) & (F.col("n") == 1)).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one row of each group of equal texts, its columns unchanged."""
    kept = exact_dedup(docs, id_col, text_col).filter("kept").select(F.col("doc_id").alias("keep_id"), F.col("text_sha256").alias("keep_sha"))
    # the row itself is one column, so that no name of its columns can clash
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    marked = docs.select(row, F.col(id_col).alias("id"), F.sha2(normalised(F.col(text_col)), 256).alias("sha"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("chars"))
    once = Window.partitionBy("sha", "id").orderBy(F.col("chars").desc())
    first = marked.join(kept, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("sha") == F.col("keep_sha"))).withColumn("n", F.row_number().over(once)).filter("n = 1")
    return first.select("row.*")
