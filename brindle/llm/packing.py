"""Packing documents into sequences of fixed length: best-two-fit.

Bins are planned on the histogram of piece lengths, which has at most
`max_length` entries whatever the size of the data. A bin is filled greedily with the longest pieces
that fit; then its smallest piece is replaced by two unpacked pieces that fill
the gap it leaves more tightly. The same bin is repeated as often as the
lengths last, so each step uses up one length and the plan stays small. Every piece finds
its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import crc32, in_small_batches, lean, materialise, per_process, slices, split_words

#: Rows that one salt of a length holds on average.
SALT_ROWS = 50_000
#: Words a worker remembers; the cache is emptied when full.
CACHED_WORDS = 200_000
#: Bytes of text that are tokenized together; arrays of their words and ids lie beside them in memory.
SLICE_BYTES = 1_000_000


class WordEncoder:
    """Token ids of texts, by way of their distinct words.

    The vocabulary's pre-tokenizer never joins characters across white space,
    so a text's ids are those of its words in order. A word of letters and
    closing punctuation, by far the most common kind, has two pre-tokens at
    most and goes to the tokenizer's model directly; any other word goes
    through the whole tokenizer.
    """

    #: Lower-case letters up to U+024F.
    PLAIN = "^[a-z\u00df-\u00f6\u00f8-\u012f\u0131-\u024f]+$"
    MARKS = ".,;:!?"
    #: How byte-level vocabularies write the bytes that are no printable Latin-1 character.
    BYTES = {b: chr(256 + n) for n, b in enumerate([*range(33), *range(127, 161), 173])}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.cache = self.tokenizer.model, {"": b""}

    def _ids(self, parts: pa.Array) -> list[bytes]:
        """The packed ids of distinct parts: plain letters, runs of marks, or whole other words."""
        cache, model, words = self.cache, self.model, parts.to_pylist()
        if len(cache) > CACHED_WORDS:
            cache.clear()
            cache[""] = b""
        new = [w for w in words if w not in cache]
        simple = pc.match_substring_regex(pa.array(new, pa.large_string()), f"{self.PLAIN}|^[{self.MARKS}]+$").to_pylist()
        other = [w for w, s in zip(new, simple, strict=True) if not s]
        for w, s in zip(new, simple, strict=True):
            if s:
                mapped = w if w.isascii() else w.encode().decode("latin-1").translate(self.BYTES)
                ids = [t.id for t in model.tokenize(mapped)]
                cache[w] = struct.pack(f"<{len(ids)}I", *ids)
        for at in range(0, len(other), 20_000):
            part = other[at : at + 20_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                cache[w] = struct.pack(f"<{len(e.ids)}I", *e.ids)
        return [cache[w] for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's begin (one entry more than texts)."""
        numbers, distinct, bounds = split_words(texts)
        lower = pc.utf8_lower(distinct)
        letters = pc.utf8_rtrim(lower, characters=self.MARKS)
        # U+0130 alone has another lower case of its own than of its simple mapping
        plain = pc.and_(pc.match_substring_regex(letters, self.PLAIN), pc.invert(pc.match_substring(distinct, "\u0130")))
        marks = pc.if_else(plain, pc.replace_substring_regex(lower, f"^.*?([{self.MARKS}]*)$", "\\1"), "").dictionary_encode()
        letters = pc.if_else(plain, letters, distinct).dictionary_encode()
        ids = self._ids(letters.dictionary) + self._ids(marks.dictionary)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table, starts = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(sizes) - sizes
        pair = np.column_stack([letters.indices.to_numpy(), marks.indices.to_numpy() + len(letters.dictionary)])
        part = pair[numbers].ravel()
        own = sizes[part]
        ends = np.concatenate([[0], np.cumsum(own)])
        return table[np.repeat(starts[part] - ends[:-1], own) + np.arange(int(ends[-1]))], ends[2 * bounds]


def pieces(docs: DataFrame, tokenizer: str, max_length: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document.

    A document's ids end with `end_id`; only longer documents are cut. Null
    texts are empty: one piece with the end alone.
    """
    end, size = struct.pack("<I", end_id), 4 * max_length

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_process(("WordEncoder", tokenizer), lambda: WordEncoder(tokenizer))
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                rows = []
                all_ids, bounds = encoder.encode(part.column(1))
                for doc_id, first, last in zip(part.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    ids = all_ids[first:last].tobytes() + end
                    for k, b in enumerate(range(0, len(ids), size)):
                        own = ids[b : b + size]
                        rows.append((doc_id, k, b // 4, len(own) // 4, crc32(own)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return in_small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(cut), "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan(counts: np.ndarray, max_length: int) -> list[tuple[int, list[int]]]:
    """Bins as (repetitions, lengths), from counts[length] for lengths up to max_length."""
    left, bins = counts.astype(np.int64).copy(), []
    sizes = np.arange(max_length + 1)

    def largest_up_to() -> np.ndarray:
        return np.maximum.accumulate(np.where(left > 0, sizes, 0))

    best = largest_up_to()
    while best[-1]:
        own, gap = [], max_length
        while best[gap]:
            x = int(best[gap])
            fit = min(int(left[x]), gap // x)
            own += [x] * fit
            left[x] -= fit
            gap -= fit * x
            if not left[x]:
                best = largest_up_to()
        while gap and own:
            smallest = own[-1]
            target = gap + smallest
            there = np.flatnonzero(left[: target + 1])
            second = best[np.minimum(target - there, there)]
            second = np.where((second == there) & (left[there] < 2), best[np.maximum(there - 1, 0)], second)
            second = np.minimum(second, target - there)
            second = np.where(left[second] > 0, second, 0)
            sums = np.where(second > 0, there + second, 0)
            if not len(sums) or sums.max() <= smallest:
                break
            k = int(sums.argmax())
            a, b = int(there[k]), int(second[k])
            own.pop()
            left[smallest] += 1
            left[a] -= 1
            left[b] -= 1
            gap = target - a - b
            own = sorted([*own, a, b], reverse=True)
            best = largest_up_to()
        used, times = np.unique(own, return_counts=True)
        more = int((left[used] // times).min())
        left[used] -= more * times
        bins.append((1 + more, own))
        best = largest_up_to()
    return bins


def _places(bins: list[tuple[int, list[int]]]) -> dict[int, list[np.ndarray]]:
    """By length: the first rank of each step, its first sequence, and its offsets."""
    places: dict[int, list] = {}
    ranks: dict[int, int] = {}
    sequence = 0
    for times, own in bins:
        offsets: dict[int, list[int]] = {}
        at = 0
        for x in own:
            offsets.setdefault(x, []).append(at)
            at += x
        for x, o in offsets.items():
            places.setdefault(x, []).append((ranks.get(x, 0), sequence, o))
            ranks[x] = ranks.get(x, 0) + times * len(o)
        sequence += times
    return places


def pack(docs: DataFrame, tokenizer: str, max_length: int = 2048, end_id: int = 0) -> DataFrame:
    """Every piece with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces of one length are dealt to salts by their places in the written table,
    which also parts repeated rows and rows without an id, and ranked by doc_id, piece and checksum within
    them; repeated rows are packed as often as they occur. Null texts are
    empty texts. A null doc_id stays null. An empty table gives an empty result.
    """
    cut = materialise(pieces(docs, tokenizer, max_length, end_id).withColumn("at", F.monotonically_increasing_id()), "pieces")
    total = cut.count()
    salts = 1 + total // SALT_ROWS
    salted = cut.withColumn("salt", F.pmod(F.xxhash64("at"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    histogram = np.zeros(max_length + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most max_length rows
        histogram[row["length"]] = row["n"]
    places = _places(plan(histogram, max_length))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "at")
    ranked = salted.withColumn("own", F.row_number().over(own)).join(first, ["length", "salt"]).withColumn("rank", F.col("first") + F.col("own") - 1)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts = {x: np.array([p[0] for p in steps]) for x, steps in places.items()}
        for pdf in frames:
            sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
            for x, rows in pdf.groupby("length").indices.items():
                rank = pdf["rank"].to_numpy()[rows]
                step = np.searchsorted(starts[x], rank, "right") - 1
                for k in np.unique(step):
                    first_rank, first_sequence, offsets = places[x][k]
                    mine = rows[step == k]
                    j = pdf["rank"].to_numpy()[mine] - first_rank
                    sequence[mine] = first_sequence + j // len(offsets)
                    offset[mine] = np.array(offsets)[j % len(offsets)]
            yield pdf.drop(columns="rank").assign(sequence_id=sequence, offset=offset)

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(lean(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
