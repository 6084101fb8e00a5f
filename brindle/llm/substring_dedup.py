"""Removing repeated passages with suffix automata of reference shards.

A passage is repeated if a window of 13 words of it also stands in a document
with a smaller id. The whole corpus as a reference would have to be streamed
against itself, so it is narrowed in exact steps first:

1. Each window has an anchor, the least of its 7-word hashes. Equal windows have
   equal anchors, so windows whose anchor is in one document only are unique.
   The others are the candidates. Consecutive windows with one anchor make a
   region of 13 to 19 words.
2. The distinct candidate regions, each with the smallest id it occurs under,
   are the reference. It is sharded by anchor, so all occurrences of a window
   meet in one shard. Each shard's suffix automaton knows for every state the
   smallest id; streaming the regions through it gives, by matching statistics
   held at 13 words, the smallest id of every window.
3. Documents take the windows with a smaller id out.

An automaton isn't broadcast to all tasks, as that would multiply the corpus by
its shards; regions go to the one shard that can match them. An anchor with more regions
than an automaton should hold is settled by grouping its windows instead.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import materialise, release, slices, split_words, words_of

WINDOW, GRAM = 13, 7
#: Regions in a shard's automaton, about; an anchor's regions stay together.
SHARD_REGIONS = 6_000
#: Regions of one anchor from which its windows are grouped instead.
CROWDED = 20_000
SLICE_BYTES = 8_000_000
_LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of every word of an Arrow array."""
    return pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(words) else np.zeros(0, np.uint64)


def gram_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` words from each position on; the last size - 1 entries have no meaning."""
    padded = np.concatenate([hashes, np.zeros(size - 1, np.uint64)])
    out = np.zeros(len(hashes), np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + padded[k : k + len(hashes)]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def regions(texts: pa.Array, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """The regions of an array of texts: (text number, first word, windows, anchor, content), in order.

    `content` is a hash of the region's words: of its first and its last window,
    which cover all of them.
    """
    numbers, distinct, bounds = split_words(texts)
    hashes = word_hashes(distinct)[numbers] if len(numbers) else np.zeros(0, np.uint64)
    own = np.repeat(np.arange(len(texts)), np.diff(bounds))
    last = bounds[1:][own] if len(own) else own
    at = np.arange(len(hashes))
    grams = gram_hashes(hashes, gram)
    best, place = grams.copy(), at.copy()
    for k in range(1, window - gram + 1):
        later = np.concatenate([grams[k:], np.full(min(k, len(grams)), _LAST)])
        less = later < best
        best, place = np.where(less, later, best), np.where(less, at + k, place)
    whole = at + window <= last
    starts = np.flatnonzero(whole & np.concatenate([[True], ~whole[:-1] | (place[1:] != place[:-1]) | (own[1:] != own[:-1])])[: len(whole)])
    stops = np.flatnonzero(whole & np.concatenate([~whole[1:] | (place[1:] != place[:-1]) | (own[1:] != own[:-1]), [True]])[: len(whole)])
    whole_windows = gram_hashes(hashes, window)
    content = whole_windows[starts] * np.uint64(0xD6E8FEB86659FD93) + whole_windows[stops] + (stops - starts).astype(np.uint64)
    return own[starts], starts - bounds[own[starts]], stops - starts + 1, best[starts].view(np.int64), content.view(np.int64)


class SuffixAutomaton:
    """Of several word sequences; every state knows the smallest owner of its substrings."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.owner = [-1], [0], [None]

    def add(self, words: list, owner: int) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)
            if self.owner[last] is None or owner < self.owner[last]:
                self.owner[last] = owner

    def _extend(self, last: int, word) -> int:
        nexts, link, length = self.next, self.link, self.length
        q = nexts[last].get(word)
        if q is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, word, q)
        new = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        self.owner.append(None)
        p = last
        while p >= 0 and word not in nexts[p]:
            nexts[p][word] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return new

    def _clone(self, p: int, word, q: int) -> int:
        new = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.owner.append(None)
        self.link[q] = new
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = new
            p = self.link[p]
        return new

    def close(self) -> None:
        """Pass the owners down the suffix links, longest states first."""
        owner, link = self.owner, self.link
        for v in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            p = link[v]
            if p > 0 and owner[v] is not None and (owner[p] is None or owner[v] < owner[p]):
                owner[p] = owner[v]

    def owners(self, words: list, window: int) -> list[int | None]:
        """For each position the smallest owner of the `window` words that end there, None without a match."""
        out, state, matched = [], 0, 0
        nexts, link, length, owner = self.next, self.link, self.length, self.owner
        for word in words:
            while state and word not in nexts[state]:
                state = link[state]
                matched = length[state]
            if word in nexts[state]:
                state = nexts[state][word]
                matched += 1
            while state and length[link[state]] >= window:
                state = link[state]
                matched = length[state]
            out.append(owner[state] if matched >= window else None)
        return out


def _scan(docs: DataFrame, columns: list[str], make, schema: str) -> DataFrame:
    """mapInArrow over slices of (columns..., text): make(slice, regions) gives the columns of a batch."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, len(columns), SLICE_BYTES):
                yield pa.RecordBatch.from_arrays(make(part, *regions(part.column(len(columns)))), names)

    return docs.select(*columns, "text").mapInArrow(run, schema)


def _shared_anchors(docs: DataFrame) -> DataFrame:
    """The anchors that windows of more than one document have."""
    rows = _scan(docs, ["doc_id"], lambda part, text, first, n, anchor, content: [pa.array(anchor), part.column(0).take(pa.array(text))], "anchor long, doc_id long")
    return rows.groupBy("anchor").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high").select("anchor")


def _kept_digest(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


def _split(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Every document with its candidate regions: those without any are done, the others keep their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, key, text, at = batch.columns
            n, digest = [], []
            for t, a in zip(text.to_pylist(), at.is_null().to_pylist(), strict=True):
                words = words_of(t) if a else []
                n.append(len(words))
                digest.append(_kept_digest(words) if a else None)
            kept = pa.array([None if a else t for t, a in zip(text.to_pylist(), at.is_null().to_pylist(), strict=True)], text.type)
            yield pa.RecordBatch.from_arrays([doc_id, key, pa.array(n, pa.int64()), pa.array(digest, pa.string()), kept, at], ["doc_id", "key", "n_words", "kept_sha256", "text", "at"])

    return docs.join(places, ["doc_id", "key"], "left").select("doc_id", "key", "text", "at").mapInArrow(run, "doc_id long, key long, n_words long, kept_sha256 string, text string, at array<int>")


def _candidate_regions(candidates: DataFrame, with_text: bool) -> DataFrame:
    """A row for each candidate region: anchor, region_hash, doc_id, and key and first or the words."""
    schema = "anchor long, region_hash long, doc_id long, " + ("region string" if with_text else "key long, first int")
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, SLICE_BYTES):
                text, first, n, anchor, content = regions(part.column(2))
                # (text, first) pairs as one number, to be found among the wanted ones
                at = part.column(3).combine_chunks() if isinstance(part.column(3), pa.ChunkedArray) else part.column(3)
                wanted = np.sort((np.repeat(np.arange(part.num_rows), np.diff(at.offsets.to_numpy())) << 32) | at.flatten().to_numpy())
                mine = (text << 32) | first
                place = np.minimum(np.searchsorted(wanted, mine), max(len(wanted) - 1, 0))
                use = wanted[place] == mine if len(wanted) else np.zeros(len(mine), bool)
                text, first, n, anchor, content = text[use], first[use], n[use], anchor[use], content[use]
                own = pa.array(text)
                if with_text:
                    split = [words_of(t) for t in part.column(2).to_pylist()]
                    rest = [pa.array([" ".join(split[t][f : f + m + WINDOW - 1]) for t, f, m in zip(text.tolist(), first.tolist(), n.tolist(), strict=True)], pa.string())]
                else:
                    rest = [part.column(1).take(own), pa.array(first, pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(content), part.column(0).take(own), *rest], names)

    return candidates.select("doc_id", "key", "text", "at").mapInArrow(run, schema)


def _automata(reference: DataFrame) -> DataFrame:
    """anchor, region_hash, owners: the smallest id of every window of each reference region."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[int, int, int, list[str]]] = []
        rows: list[tuple[int, int, int, list[str]]] = []
        alone: list[tuple[int, int, list[int]]] = []

        def close_group() -> None:
            if len(group) == 1:  # the anchor's only region: whoever has it has all of its windows
                anchor, content, doc_id, words = group[0]
                alone.append((anchor, content, [doc_id] * (len(words) - WINDOW + 1)))
            else:
                rows.extend(group)
            group.clear()

        def settle() -> pa.RecordBatch:
            automaton, ids = SuffixAutomaton(), {}
            coded = [[ids.setdefault(w, len(ids)) for w in words] for *_, words in rows]
            for (_, _, doc_id, _), words in zip(rows, coded, strict=True):
                automaton.add(words, doc_id)
            automaton.close()
            done = alone + [(r[0], r[1], automaton.owners(words, WINDOW)[WINDOW - 1 :]) for r, words in zip(rows, coded, strict=True)]
            rows.clear()
            alone.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["anchor", "region_hash", "owners"])

        for batch in batches:
            for anchor, content, doc_id, region in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and anchor != group[-1][0]:
                    close_group()
                    if len(rows) >= SHARD_REGIONS or len(alone) >= 10 * SHARD_REGIONS:
                        yield settle()
                group.append((anchor, content, doc_id, region.split(" ")))
        if group:
            close_group()
        if rows or alone:
            yield settle()

    ordered = reference.repartition("anchor").sortWithinPartitions("anchor")
    return ordered.select("anchor", "region_hash", "doc_id", "region").mapInArrow(run, "anchor long, region_hash long, owners array<long>")


def _grouped_windows(reference: DataFrame) -> DataFrame:
    """The same as `_automata` by grouping equal windows, for anchors with too many regions for one task."""
    words = F.split("region", " ")
    windows = reference.select("anchor", "region_hash", "doc_id", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.array_join(F.slice(words, i, WINDOW), " "))).alias("n", "window"))
    least = windows.groupBy("window").agg(F.min("doc_id").alias("owner"))
    back = windows.join(least, "window").groupBy("anchor", "region_hash").agg(F.array_sort(F.collect_list(F.struct("n", "owner"))).alias("all"))
    return back.select("anchor", "region_hash", F.col("all.owner").alias("owners"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the words left, joined by spaces) of every row.

    Windows are judged on the input. Null texts have no words; texts with fewer
    than 13 words have no window and lose nothing. Windows repeated within one
    document, or between rows of one id, stay. Rows without an id neither lose
    nor cause anything. Other columns aren't read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("key", F.xxhash64("text"))  # with the id it stands for a row
    named = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    shared = materialise(_shared_anchors(named), "shared-anchors")
    release(spark)
    places = _scan(named, ["doc_id", "key"], lambda part, text, first, n, anchor, content: [pa.array(anchor), part.column(0).take(pa.array(text)), part.column(1).take(pa.array(text)), pa.array(first.astype(np.int32))], "anchor long, doc_id long, key long, at int")
    places = materialise(places.join(shared, "anchor", "left_semi").groupBy("doc_id", "key").agg(F.collect_set("at").alias("at")), "candidate-places")
    release(spark)
    split = materialise(_split(rows, places), "candidates")
    release(spark)
    candidates = split.filter("at IS NOT NULL")
    reference = materialise(_candidate_regions(candidates, True).groupBy("anchor", "region_hash", "region").agg(F.min("doc_id").alias("doc_id")), "reference-regions")
    release(spark)
    crowded = reference.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > CROWDED).select("anchor")
    crowded = materialise(crowded, "crowded-anchors")
    owners = _automata(reference.join(crowded, "anchor", "left_anti"))
    if crowded.limit(1).count():
        owners = owners.unionByName(_grouped_windows(reference.join(crowded, "anchor", "left_semi")))
    owners = materialise(owners, "window-owners")
    release(spark)
    marked = _candidate_regions(candidates, False).join(owners, ["anchor", "region_hash"])
    starts = F.transform(F.filter(F.transform("owners", lambda o, i: F.when(o < F.col("doc_id"), F.col("first") + i)), lambda x: x.isNotNull()), lambda x: x.cast("int"))
    removed = marked.withColumn("starts", starts).filter(F.size("starts") > 0).groupBy("doc_id", "key").agg(F.flatten(F.collect_list("starts")).alias("starts"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, n, digest, text, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest is not None:
                    out.append((doc_id, n, 0, digest))
                    continue
                words = words_of(text)
                gone = np.zeros(len(words) + 1, np.int64)
                first = np.unique(np.array(starts or [], np.int64))
                np.add.at(gone, first, 1)
                np.add.at(gone, first + WINDOW, -1)
                left = np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()
                out.append((doc_id, len(words), len(words) - len(left), _kept_digest([words[k] for k in left])))
            columns = zip(*out, strict=True) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    done = split.join(removed, ["doc_id", "key"], "left").select("doc_id", "n_words", "kept_sha256", "text", "starts")
    return done.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string")
