"""Language-model scores by context-tree weighting over binary-decomposed bytes.

A byte is eight binary decisions. Each decision has a node in the context of the
last 0 to D bytes, with Krichevsky-Trofimov estimates from the counts of zeros
and ones in training. A node's weighted probability mixes its own estimate with
the product of its children's, one byte deeper, half and half; the share of its own
estimate after training is its weight in prediction. The predictions of all
depths are mixed by these weights to the probability of a bit, and the eight
bits make the byte. A context without training counts predicts one half.

Documents are dealt to slices by a hash. A task streams through a slice, which asks for each context and byte, and
each word, that it holds, once, with its training count. Spark sums up the
requests, which is all of the corpus' statistics, and builds the tree level by
level: a task streams through sorted contexts, holding those with the same last
D - 1 bytes, and the levels above are sums. One value for each distinct request
goes back to the slices that asked. So nothing that grows with the corpus is broadcast
or held by a task.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import SPACE, discard, held_out, in_small_batches, materialise, release, residue, split_words, tidy, trim
from brindle.llm.substring_dedup import word_hashes

DEPTH = 5
#: Bytes of text in a slice, about, and in a piece, which is worked on at once.
SLICE_BYTES, PIECE_BYTES = 24_000_000, 1_000_000
#: Texts in a piece, at most: their number stands beside a key of six bytes in one of eight.
PIECE_TEXTS = 1 << 16
#: Keys of pieces that are held before they are merged.
HELD_KEYS = 1_000_000
#: Rows of sorted contexts that are worked on at once, besides those of one parent.
BLOCK_ROWS = 50_000
CONTEXT, WORD, TEXT, END = 0, 1, 2, "\n"
SMOOTH = 0.1


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln gamma for x > 0, by Stirling's series from 8 on."""
    x = np.asarray(x, float)
    up, y = np.zeros_like(x), x.copy()
    for _ in range(8):
        low = y < 8
        up[low] += np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - up


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


class Level:
    """All nodes of one depth: sorted keys (context, bits so far), counts, and weighted probabilities."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        symbol = keys & np.uint64(0xFF)
        nodes, zeros, ones = [], [], []
        for bit in range(8):
            at = node_ids(keys, bit, depth)
            one = ((symbol >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
            nodes.append(at)
            zeros.append(np.where(one, 0, counts))
            ones.append(np.where(one, counts, 0))
        self.nodes, index = np.unique(np.concatenate(nodes), return_inverse=True)
        self.zeros = np.bincount(index, np.concatenate(zeros), len(self.nodes))
        self.ones = np.bincount(index, np.concatenate(ones), len(self.nodes))
        self.own = log_kt(self.zeros, self.ones)
        self.weighted, self.weight, self.depth = self.own.copy(), np.ones(len(self.nodes)), depth

    def mix(self, below: np.ndarray) -> None:
        """Take in the sums of the children's weighted probabilities (as logarithms)."""
        self.weighted = np.logaddexp(self.own, below) + math.log(0.5)
        self.weight = np.exp(self.own + math.log(0.5) - self.weighted)

    def above(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parents of the nodes, and for each the sums of the columns of `values` over its children here."""
        bits = np.uint64(8 * (self.depth - 1))
        parents = (self.nodes & np.uint64(0xFF)) | (((self.nodes >> np.uint64(8)) & ((np.uint64(1) << bits) - np.uint64(1))) << np.uint64(8))
        keys, index = np.unique(parents, return_inverse=True)
        return keys, np.stack([np.bincount(index, v, len(keys)) for v in values])

    def predict(self, keys: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the nodes at a bit of these keys: their own probability of a one, and their weight."""
        at = np.searchsorted(self.nodes, node_ids(keys, bit, self.depth))
        return (self.ones[at] + 0.5) / (self.zeros[at] + self.ones[at] + 1), self.weight[at]


def node_ids(keys: np.ndarray, bit: int, depth: int) -> np.ndarray:
    """The node of each (context, byte) key at a depth and bit: the context's last bytes and the bits so far after a one."""
    context, symbol = (keys >> np.uint64(8)) & np.uint64((1 << 8 * depth) - 1), keys & np.uint64(0xFF)
    return (context << np.uint64(8)) | np.uint64(1 << bit) | (symbol >> np.uint64(8 - bit))


def grow(keys: np.ndarray, counts: np.ndarray, depths: range) -> list[Level]:
    """The levels of the given depths from counts of (context, byte) keys, the shallowest first."""
    levels = [Level(keys, counts, d) for d in depths]
    for above, below in zip(levels[-2::-1], levels[:0:-1], strict=True):
        above.mix(below.above(below.weighted[None])[1][0])  # a level's nodes are the parents of the next one's
    return levels


def bit_probabilities(levels: list[Level], keys: np.ndarray) -> np.ndarray:
    """(keys, 8): the probability of a one at each bit, mixed over the levels, for keys that they were grown from."""
    out = np.full((len(keys), 8), 0.5)
    for level in reversed(levels):
        for bit in range(8):
            own, weight = level.predict(keys, bit)
            out[:, bit] = weight * own + (1 - weight) * out[:, bit]
    return out


def log10_of(probabilities: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """log10 of each key's byte, from the probabilities of ones."""
    ones = (keys[:, None] >> np.arange(7, -1, -1, dtype=np.uint64)) & np.uint64(1)
    return np.log10(np.where(ones == 1, probabilities, 1 - probabilities)).sum(1)


def context_keys(pieces: list[bytes], before: list[bytes] | None = None, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Every byte with its context as one number, and where each piece's bytes begin. A text's first piece begins after zeros."""
    heads = before or [b"\0" * depth] * len(pieces)
    data = np.frombuffer(b"".join(h + t for h, t in zip(heads, pieces, strict=True)), np.uint8).astype(np.uint64)
    keys = np.zeros(max(len(data) - depth, 0), np.uint64)
    for d in range(depth, -1, -1):
        keys = (keys << np.uint64(8)) | data[depth - d : len(data) - d]
    sizes = np.array([len(t) for t in pieces], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    if len(pieces) < 2:
        return keys, starts
    # between two pieces lie `depth` keys that belong to neither
    use = np.ones(len(keys), bool)
    use[(starts[1:-1, None] + depth * np.arange(len(pieces) - 1)[:, None] + np.arange(depth)).ravel()] = False
    return keys[use], starts


def _cut(text: str) -> Iterator[str]:
    """A text in parts of about PIECE_BYTES characters, cut at white space. The last one has a word, if the text has any."""
    text, at = text.strip(SPACE), 0
    while len(text) - at > PIECE_BYTES:
        m = _SPACE.search(text, at + PIECE_BYTES)
        if m is None:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


_SPACE = re.compile(f"[{SPACE}]")


class _Piece:
    """Words and contexts of parts of texts: (row, part, whether it is the text's last).

    The model sees a text as its lower-case words, each but the last followed by a space, and the end.
    """

    def __init__(self, parts: list[tuple[int, str, bool]], before: bytes):
        self.rows = np.array([r for r, _, _ in parts])
        numbers, distinct, bounds = split_words(pc.ascii_lower(pa.array([t for _, t, _ in parts], pa.large_string())))
        self.hashes = word_hashes(pa.concat_arrays([distinct.cast(pa.large_string()), pa.array([END], pa.large_string())])).view(np.int64)
        self.numbers, self.words = numbers, np.diff(bounds)
        self.last = np.array([e for _, _, e in parts])
        words = pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), distinct.cast(pa.large_string()).take(pa.array(numbers)))
        tails = [END.encode() if e else b" " for _, _, e in parts]
        joined = pc.binary_join(words, pa.scalar(" ", pa.large_string())).cast(pa.large_binary()).to_pylist()
        texts = [text + tail if text or tail != b" " else b"" for text, tail in zip(joined, tails, strict=True)]
        self.keys, self.starts = context_keys(texts, [before, *[b"\0" * DEPTH] * (len(texts) - 1)])
        self.end = (before + texts[-1])[-DEPTH:]

    def sorted_keys(self, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The keys in order, each once, where each one's bytes begin among all, and for every byte, in this order, the small number that `beside` has for its text."""
        both = np.sort((self.keys << np.uint64(16)) | np.repeat(beside.astype(np.uint64), np.diff(self.starts)))
        keys = both >> np.uint64(16)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[first], first, (both & np.uint64(0xFFFF)).astype(np.int64)


def _pieces(texts: list[str | None]) -> Iterator[_Piece]:
    """All texts in pieces of about PIECE_BYTES; a very long text takes several, each after the last bytes of the one before."""
    waiting: list[tuple[int, str, bool]] = []
    size, before = 0, b"\0" * DEPTH
    for row, text in enumerate(texts):
        parts = list(_cut(text or ""))
        for k, part in enumerate(parts):
            last = k + 1 == len(parts)
            waiting.append((row, part, last))
            size += len(part)
            if size >= PIECE_BYTES or not last or len(waiting) == PIECE_TEXTS:
                piece = _Piece(waiting, before)
                yield piece
                waiting, size, before = [], 0, b"\0" * DEPTH if last else piece.end
    if waiting:
        yield _Piece(waiting, before)


class _Counts:
    """Counts by key, merged now and then."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.parts.append((keys, counts))
        if len(self.parts) > 1 and sum(len(k) for k, _ in self.parts[1:]) > HELD_KEYS:  # the first is what was merged so far
            self.parts = [self.merged()]

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, index = np.unique(np.concatenate([k for k, _ in self.parts]), return_inverse=True)
        return keys, np.bincount(index, np.concatenate([n for _, n in self.parts]), len(keys)).astype(np.int64)


def _runs(batch: pa.RecordBatch, *columns: int) -> Iterator[pa.RecordBatch]:
    """The batch cut where one of the integer columns changes."""
    edges = np.zeros(max(batch.num_rows - 1, 0), bool)
    for k in columns:
        edges |= np.diff(batch.column(k).to_numpy()) != 0
    cuts = [0, *(np.flatnonzero(edges) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if a < b:
            yield batch.slice(a, b - a)


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each slice asks for, from its rows (slice, learn, text): (slice, kind, key, n) with the training count n of the slice."""

    def asked() -> pa.RecordBatch:
        (keys, n), (hashes, m) = contexts.merged(), words.merged()
        kinds = np.concatenate([np.full(len(keys), CONTEXT), np.full(len(hashes), WORD)]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(kinds), present), pa.int32()), pa.array(kinds), pa.array(np.concatenate([keys.view(np.int64), hashes])), pa.array(np.concatenate([n, m]))], ["slice", "kind", "key", "n"])

    present, contexts, words = None, _Counts(), _Counts()
    for batch in batches:
        for part in _runs(batch, 0):
            number = part.column(0)[0].as_py()
            if number != present:
                if present is not None:
                    yield asked()
                present, contexts, words = number, _Counts(), _Counts()
                trim()
            learn = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            for piece in _pieces(part.column(2).to_pylist()):
                own = learn[piece.rows]
                keys, first, learned = piece.sorted_keys(own)
                contexts.add(keys, np.add.reduceat(learned, first) if len(keys) else learned)
                counts = np.bincount(piece.numbers, np.repeat(own, piece.words), len(piece.hashes))
                counts[-1] += own[piece.last].sum()
                words.add(piece.hashes, counts)
    if present is not None:
        yield asked()


def _blocks(batches: Iterator[pa.RecordBatch], group) -> Iterator[pa.Table]:
    """Sorted rows in tables of BLOCK_ROWS and more that never part rows of one group: `group` gives each row's."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) < BLOCK_ROWS:
            continue
        rows = pa.Table.from_batches(waiting).combine_chunks()
        edges = np.flatnonzero(np.diff(group(rows)))
        if len(edges):
            yield rows.slice(0, int(edges[-1]) + 1)
            rows = rows.slice(int(edges[-1]) + 1)
        waiting = rows.combine_chunks().to_batches()
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _unsigned(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().view(np.uint64)


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted (parent, key, c) the sums for the nodes two levels above the leaves: (node, zeros, ones, below)."""
    for block in _blocks(batches, lambda rows: rows.column(0).to_numpy()):
        level = grow(_unsigned(block.column(1)), block.column(2).to_numpy(), range(DEPTH - 1, DEPTH + 1))[0]
        nodes, (zeros, ones, below) = level.above(np.stack([level.zeros, level.ones, level.weighted]))
        yield pa.RecordBatch.from_arrays([pa.array(nodes.view(np.int64)), pa.array(zeros.astype(np.int64)), pa.array(ones.astype(np.int64)), pa.array(below)], ["node", "zeros", "ones", "below"])


def _mixed(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of inner nodes: their own probability of a one, their weight, and the logarithm of their weighted probability."""
    kt = log_kt(zeros, ones)
    weighted = np.logaddexp(kt, below) + math.log(0.5)
    return (ones + 0.5) / (zeros + ones + 1), np.exp(kt + math.log(0.5) - weighted), weighted


NODES = "node long, zeros long, ones long, own double, weight double, weighted double"


def _level(sums: DataFrame, name: str) -> DataFrame:
    """The nodes of a level from what the one below gives them: (node, zeros, ones, below), several rows a node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _mixed(*(batch.column(k).to_numpy() for k in (1, 2, 3)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, found)], ["node", "zeros", "ones", "own", "weight", "weighted"])

    return materialise(_summed(sums).mapInArrow(tidy(run), NODES), name)


def _summed(sums: DataFrame) -> DataFrame:
    return sums.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below"))


def _parent(node: Column, depth: int) -> Column:
    """The node of the context one byte shorter, `depth` bytes."""
    mask = (1 << 8 * depth) - 1
    return F.shiftleft(F.shiftright(node, 8).bitwiseAND(F.lit(mask)), 8).bitwiseOR(node.bitwiseAND(F.lit(0xFF)))


def _upwards(level: DataFrame, depth: int) -> DataFrame:
    return level.select(_parent(F.col("node"), depth).alias("node"), "zeros", "ones", F.col("weighted").alias("below"))


def _top(sums: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of the two shallowest levels, from the sums of depth 1: a and b by node, where the mixture is a + b times what the deeper levels say."""
    node = sums["node"].to_numpy(np.int64)
    own, weight, weighted = _mixed(*(sums[c].to_numpy(float) for c in ("zeros", "ones", "below")))
    root = [np.bincount(node & 0xFF, v, 256) for v in (sums["zeros"].to_numpy(float), sums["ones"].to_numpy(float), weighted)]
    own0, weight0, _ = _mixed(*root)
    a, b = np.full(1 << 16, 0.5), np.zeros(1 << 16)
    low = node & 0xFF
    a[node] = weight0[low] * own0[low] + (1 - weight0[low]) * weight * own
    b[node] = (1 - weight0[low]) * (1 - weight)
    return a, b


def _context_values(keys: DataFrame) -> DataFrame:
    """key, value: log10 of the probability of a byte in its context, for every key (key, c) asked for."""
    context = F.shiftright("key", 8)
    parent = context.bitwiseAND(F.lit((1 << 8 * (DEPTH - 1)) - 1))
    ordered = keys.select(parent.alias("parent"), "key", "c").repartition("parent").sortWithinPartitions("parent")
    third = _level(ordered.mapInArrow(tidy(_leaves), "node long, zeros long, ones long, below double"), "level-3")
    second = _level(_upwards(third, 2), "level-2")
    top_a, top_b = _top(_summed(_upwards(second, 1)).toPandas())  # at most 65,280 rows: the nodes after one byte

    def under_top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, own, weight = (batch.column(k).to_numpy() for k in range(3))
            above = node & 0xFFFF
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(top_a[above] + top_b[above] * weight * own), pa.array(top_b[above] * (1 - weight))], ["up", "a", "b"])

    mixed = second.select("node", "own", "weight").mapInArrow(tidy(under_top), "up long, a double, b double")
    mixed = third.withColumn("up", _parent(F.col("node"), 2)).join(mixed, "up")
    mixed = mixed.select("node", (F.col("a") + F.col("b") * F.col("weight") * F.col("own")).alias("a"), (F.col("b") * (1 - F.col("weight"))).alias("b"))

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams through the nodes of a context of three bytes and then the keys in it."""
        nodes, a, b = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)
        for block in _blocks(batches, lambda rows: rows.column(2).to_numpy() * 2 + rows.column(1).to_numpy()):
            is_key, ids = block.column(1).to_numpy() == 1, _unsigned(block.column(3))
            mine = ~is_key
            nodes, a, b = np.concatenate([nodes, ids[mine]]), np.concatenate([a, block.column(4).to_numpy()[mine]]), np.concatenate([b, block.column(5).to_numpy()[mine]])
            order = np.argsort(nodes)
            nodes, a, b = nodes[order], a[order], b[order]
            if is_key.any():
                own = ids[is_key]
                p = bit_probabilities(grow(own, block.column(4).to_numpy()[is_key], range(DEPTH - 1, DEPTH + 1)), own)
                for bit in range(8):
                    at = np.searchsorted(nodes, node_ids(own, bit, DEPTH - 2))
                    p[:, bit] = a[at] + b[at] * p[:, bit]
                yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(log10_of(p, own))], ["key", "value"])
            still = nodes >> np.uint64(8) == np.uint64(block.column(0)[-1].as_py())  # the next block may go on with the last context
            nodes, a, b = nodes[still], a[still], b[still]

    short = F.lit((1 << 8 * (DEPTH - 2)) - 1)
    rows = mixed.select(F.shiftright("node", 8).alias("short"), F.lit(0).alias("is_key"), F.shiftright("node", 8).alias("parent"), F.col("node").alias("id"), "a", "b")
    rows = rows.unionByName(keys.select(context.bitwiseAND(short).alias("short"), F.lit(1).alias("is_key"), parent.alias("parent"), F.col("key").alias("id"), F.col("c").cast("double").alias("a"), F.lit(0.0).alias("b")))
    return rows.repartition("short").sortWithinPartitions("short", "is_key", "parent").mapInArrow(tidy(values), "key long, value double")


def _scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores of documents, from sorted rows: of each slice the values of contexts, then those of words, then documents."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "n_bytes", "base_score", "score"]
    present, waiting, tables = None, ([], []), None
    for batch in batches:
        for part in _runs(batch, 0, 1):
            number, kind = part.column(0)[0].as_py(), part.column(1)[0].as_py()
            if number != present:
                present, waiting, tables = number, ([], []), None
                trim()
            if kind != TEXT:
                # copies, as a view keeps all columns of its batch; whether a context is known isn't asked
                waiting[kind].append([np.array(part.column(k)) for k in ((2, 3) if kind == CONTEXT else (2, 3, 4))])
                continue
            if tables is None:
                tables, waiting = [[np.concatenate(c) for c in zip(*rows, strict=True)] for rows in waiting], None
            (keys, of_key), (hashes, of_word, seen) = tables
            n = part.num_rows
            tokens, n_known, n_bytes, base, score = np.zeros((5, n))
            for piece in _pieces(part.column(7).to_pylist()):
                own, first, texts = piece.sorted_keys(np.arange(len(piece.rows)))
                add = lambda rows, values: np.bincount(rows, values, n)
                of_own = of_key[np.searchsorted(keys, own.view(np.int64))]
                score += add(piece.rows[texts], np.repeat(of_own, np.diff(first, append=len(texts))))
                n_bytes += add(piece.rows, np.diff(piece.starts))
                at = np.searchsorted(hashes, piece.hashes)
                rows = np.repeat(piece.rows, piece.words)
                tokens += add(piece.rows, piece.words + piece.last)
                n_known += add(rows, seen[at][piece.numbers]) + add(piece.rows, seen[at[-1]] * piece.last)
                base += add(rows, of_word[at][piece.numbers]) + add(piece.rows, of_word[at[-1]] * piece.last)
            yield pa.RecordBatch.from_arrays([part.column(5), part.column(6), *(pa.array(x.astype(np.int64)) for x in (tokens, n_known, n_bytes)), pa.array(base), pa.array(score)], names)


def score_documents(docs: DataFrame, modulus: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row.

    bits_per_byte is the code length of the text as the model sees it, words
    with single spaces and the end, by its bytes. The model learns from rows
    whose residue isn't 0; a row without an id is
    scored but not learned from, and not held out. Null texts are empty: one
    token, the end. Repeated rows count as often as they occur, and very long
    texts are worked on in pieces that keep their contexts. If there are no
    training rows, every estimate is that of no counts. Other columns aren't
    read; an empty table gives an empty result.
    """
    spark = in_small_batches(docs).sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    own = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 + size // SLICE_BYTES)).cast("int")
    learn = F.coalesce(residue(F.col("doc_id"), modulus) != 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), "text", held_out(F.col("doc_id"), modulus).alias("held_out"), learn.alias("learn"), own.alias("slice"))
    dealt = rows.select("slice", "learn", "text").repartition("slice").sortWithinPartitions("slice")
    requests = materialise(dealt.mapInArrow(tidy(_requests), "slice int, kind int, key long, n long"), "requests")
    release(spark)
    counts = materialise(requests.groupBy("kind", "key").agg(F.sum("n").alias("c")), "corpus-counts")
    release(spark)
    words = counts.filter(F.col("kind") == WORD)
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = int(total["n"]), int(total["v"])
    base = F.log10((F.col("c") + SMOOTH) / F.lit(n + SMOOTH * (v + 1)))
    contexts = _context_values(counts.filter(F.col("kind") == CONTEXT).select("key", "c"))
    model = contexts.select(F.lit(CONTEXT).alias("kind"), "key", "value", F.lit(1).alias("known")).unionByName(words.select("kind", "key", base.alias("value"), F.when(F.col("c") > 0, 1).otherwise(0).alias("known")))
    model = materialise(model, "model-values")
    discard(counts)
    replies = materialise(requests.select("slice", "kind", "key").join(model, ["kind", "key"]).select("slice", "kind", "key", "value", "known"), "replies")
    discard(requests)
    discard(model)
    release(spark)
    texts = rows.select("slice", F.lit(TEXT).alias("kind"), "doc_id", "held_out", "text")
    both = replies.unionByName(texts, allowMissingColumns=True).select("slice", "kind", "key", "value", "known", "doc_id", "held_out", "text")
    both = both.repartition("slice").sortWithinPartitions("slice", "kind", "key")
    scored = both.mapInArrow(tidy(_scores), "doc_id long, held_out boolean, n_tokens long, n_known long, n_bytes long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score", (-F.col("score") * math.log2(10) / F.col("n_bytes")).alias("bits_per_byte"))
