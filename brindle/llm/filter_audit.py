"""How five quality filters interact, in every order of applying them.

Texts are scanned in their Arrow buffers: a table gives each byte its classes,
prefix sums count them per document, and the words' hashes, sorted per
document, give the distinct ones. Equal hashes are verified by the words'
bytes. What leaves the scan is a mask of failed filters and a digest of the text
for each row; all tables of the audit are sums over the 32 masks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import SPACE, slices, text_bytes

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
#: Characters that no text may hold.
SYMBOLS = "#$%&*|"
SLICE_BYTES = 4_000_000
#: Rows scanned at once, at most: a document's number in its slice has 16 bits of the sorted keys.
SLICE_ROWS = 60_000
#: Words of more bytes are hashed and compared one by one.
LONG_WORD = 256

_WORD, _CAPITAL, _SYMBOL, _POINT = 1, 2, 4, 8
CLASSES = np.zeros(256, np.uint8)
CLASSES[[b for b in range(256) if chr(b) not in SPACE]] |= _WORD
CLASSES[65:91] |= _CAPITAL
CLASSES[[ord(c) for c in SYMBOLS]] |= _SYMBOL
CLASSES[[b for b in range(256) if b & 0xC0 != 0x80]] |= _POINT  # all but continuation bytes begin a code point


def _blocks(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the data."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), "<u8", padded, strides=(1,))


_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, by blocks of eight bytes."""
    view, hashes = _blocks(data), lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    active, at = np.flatnonzero(lengths <= LONG_WORD), 0
    while len(active):
        block = view[starts[active] + at] & _MASKS[np.minimum(lengths[active] - at, 8)]
        mixed = (hashes[active] ^ block) * np.uint64(0xBF58476D1CE4E5B9)
        hashes[active] = mixed ^ (mixed >> np.uint64(29))
        at += 8
        active = active[lengths[active] > at]
    for k in np.flatnonzero(lengths > LONG_WORD):
        word = data[starts[k] : starts[k] + lengths[k]]
        hashes[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return hashes


def equal_words(data: np.ndarray, lengths: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the words that begin at a and at b, of the same lengths, have the same bytes."""
    view, same, active, at = _blocks(data), np.ones(len(a), bool), np.flatnonzero(lengths <= LONG_WORD), 0
    while len(active):
        mask = _MASKS[np.minimum(lengths[active] - at, 8)]
        same[active] &= (view[a[active] + at] & mask) == (view[b[active] + at] & mask)
        at += 8
        active = active[lengths[active] > at]
    for k in np.flatnonzero(lengths > LONG_WORD):
        same[k] = bool(np.array_equal(data[a[k] : a[k] + lengths[k]], data[b[k] : b[k] + lengths[k]]))
    return same


def distinct_words(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, doc: np.ndarray, n_docs: int, hashes: np.ndarray | None = None) -> np.ndarray:
    """Distinct words of each document: runs in the sorted hashes, each run verified by bytes.

    A document in which two different words have one hash is counted again by its words.
    """
    if not len(starts):
        return np.zeros(n_docs, np.int64)
    hashes = word_hashes(data, starts, lengths) if hashes is None else hashes
    keys = (doc.astype(np.uint64) << np.uint64(48)) | (hashes >> np.uint64(16))
    order = np.argsort(keys)
    keys = keys[order]
    repeats = np.r_[False, keys[1:] == keys[:-1]]
    out = np.bincount(doc[order[~repeats]], minlength=n_docs)
    now = np.flatnonzero(repeats)
    a, b = order[now - 1], order[now]
    wrong = lengths[a] != lengths[b]
    wrong |= ~equal_words(data, np.minimum(lengths[a], lengths[b]), starts[a], starts[b])
    for d in np.unique(doc[b[wrong]]):
        mine = np.flatnonzero(doc == d)
        out[d] = len({data[s : s + n].tobytes() for s, n in zip(starts[mine].tolist(), lengths[mine].tolist(), strict=True)})
    return out


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    """words, distinct, capitals, symbols and points (code points) of each text."""
    data, bounds = text_bytes(texts)
    classes = CLASSES[data]

    def count(bit: int) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum((classes & bit) != 0, dtype=np.int64)])
        return np.diff(sums[bounds])

    out = {"capitals": count(_CAPITAL), "symbols": count(_SYMBOL), "points": count(_POINT)}
    word, first = (classes & _WORD) != 0, np.zeros(len(data) + 1, bool)
    first[bounds] = True  # a word ends with its document
    begins = word & (np.r_[True, ~word[:-1]] | first[:-1]) if len(word) else word
    ends = word & (np.r_[~word[1:], True] | first[1:]) if len(word) else word
    starts = np.flatnonzero(begins)
    lengths = np.flatnonzero(ends) + 1 - starts
    own = np.concatenate([[0], np.cumsum(begins, dtype=np.int64)])[bounds]
    out["words"] = np.diff(own)
    doc = np.repeat(np.arange(len(texts)), out["words"])
    return out | {"distinct": distinct_words(data, starts, lengths, doc, len(texts))}


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, part (the language, '' for null), mask of the failed filters A to D, and the SHA-256 of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for rows in slices(batch.slice(at, SLICE_ROWS), 2, SLICE_BYTES):
                    m = measures(rows.column(2))
                    failed = (m["words"] < LEAST_WORDS, 100 * m["distinct"] < LEAST_DISTINCT * m["words"], 100 * m["capitals"] > MOST_CAPITALS * m["points"], m["symbols"] > 0)
                    mask = sum(f.astype(np.int32) << k for k, f in enumerate(failed))
                    data, bounds = text_bytes(rows.column(2))
                    digests = [hashlib.sha256(data[a:b]).digest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(mask, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "digest"])

    columns = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string"))
    return columns.mapInArrow(run, "doc_id long, part string, mask int, digest binary")


#: Salts of rows without an id, which no label belongs to.
NO_ID_SALTS = 1024


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask of the failed filters A to E, and how many rows have it: n, good (quality 1), toxic (toxic 1).

    E fails where the whole table has the same text under a smaller id. Rows
    are counted by text and id first, then by text, part and labels, so a group
    of copies, however large, reaches the comparison of ids as a few rows.
    """
    rows = scan(docs).groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n"))
    told = labels.select(F.col("doc_id").cast("long"), "quality", "toxic").filter("doc_id IS NOT NULL")
    told = told.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")).withColumn("salt", F.lit(0).cast("long"))
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(NO_ID_SALTS))).otherwise(F.lit(0).cast("long"))
    marked = rows.withColumn("salt", salt).join(told, ["doc_id", "salt"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    known = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    groups = marked.groupBy("digest", "part", "mask", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"), F.min(known).alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    original = F.col("no_id") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    counted = groups.withColumn("first", first).withColumn("original", original)
    both = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("original").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - F.col("original")).alias("n")))).alias("x")
    each = counted.select("part", "good", "toxic", both).filter("x.n > 0")
    return each.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("good")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic"))


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _reductions() -> tuple[list[str], np.ndarray, dict[str, np.ndarray]]:
    """For every order and step the name of the order, the step, and which masks count as what."""
    every, size, names, steps = np.arange(32), np.array([m.bit_count() for m in range(32)]), [], []
    chosen: dict[str, list[np.ndarray]] = {c: [] for c in ("kept", "removed", "redundant", "unique_fails", "shapley")}
    orders = list(permutations(FILTERS))
    for order in orders:
        seen = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            fails, gone = (every & bit) > 0, (every & seen) > 0
            seen |= bit
            for c, value in (("kept", (every & seen) == 0), ("removed", fails & ~gone), ("redundant", fails & gone), ("unique_fails", every == bit), ("shapley", np.where(fails, len(orders) // np.maximum(size, 1), 0))):
                chosen[c].append(np.asarray(value, np.int64))  # a filter is the first of k failed ones in one order of k
            names.append("".join(order))
            steps.append(step)
    return names, np.array(steps, np.int32), {c: np.array(v) for c, v in chosen.items()}


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of COUNTS, for each part and all 120 orders of the filters.

    A text fails A with under LEAST_WORDS words, B with under LEAST_DISTINCT
    percent distinct words, C with over MOST_CAPITALS percent of its characters
    in A-Z, D with any of SYMBOLS, and E if a smaller id has the same text
    (SHA-256). Null texts are empty, null languages the part ''. Rows without an
    id never fail E, nor does anything because of them; repeated rows count
    each. Where a label occurs more than once, any 1 counts; null labels and
    documents without are neither. An empty table gives no rows. Other columns
    are left out.
    """
    names, steps, chosen = _reductions()

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = {c: np.zeros(32, np.int64) for c in ("n", "good", "toxic")}
        for c, values in counts.items():
            np.add.at(values, pdf["mask"].to_numpy(), pdf[c].to_numpy())
        columns = {c: chosen[c] @ counts["n"] for c in chosen} | {"good_lost": chosen["removed"] @ counts["good"], "toxic_lost": chosen["removed"] @ counts["toxic"]}
        return pd.DataFrame({"part": pdf["part"].iloc[0], "filter_order": names, "step": steps, **{c: columns[c] for c in COUNTS}})

    return masks(docs, labels).groupBy("part").applyInPandas(reduce, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
