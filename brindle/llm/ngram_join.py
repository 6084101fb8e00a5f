"""Similar documents by n-gram sets: multiple-global-order filtering.

Two sets with a Jaccard similarity of t share ceil(t n) tokens of either, so
under any total order of tokens their prefixes of n - ceil(t n) + 1 tokens meet,
and prefixes longer by l - 1 tokens share at least l. A pair must pass four
orders before its sets are compared:

* Hash order, with the longer prefixes. A set with fewer than l prefix tokens
  that any other set has in its own prefix can't have a partner and is out,
  without a pair being made.
* Rarest first, by exact counts, among the prefix tokens of the sets that are
  left. Sets that share l of them meet in all but the l - 1 commonest. The sets
  in tokens that are still crowded are ordered again by all of their tokens,
  where frequent passages come last and seldom make a pair.
* Two more hash orders, whose prefixes each set carries as bitmaps: a pair's
  bitmaps must meet in both.

Pairs that pass are held against parity bitmaps (each token flips one of 1024
bits, so two sets differ in as many tokens as bits at least), checked for the shared
part of their hash-order prefixes and then verified on whole sets, of 64-bit token
hashes. Documents with equal sets are one class and
never compared. Where many classes meet in one token, all are compared with a
few pivots first; as only components are wanted, later rounds take just the classes
that aren't connected yet, and the last one compares all of those that are left
in different components, so no link between components is missed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import discard, in_small_batches, lean, materialise, release, slices, split_words
from brindle.llm.components import components
from brindle.llm.substring_dedup import gram_hashes, word_hashes

GRAM = 5
#: The threshold, as percents of the union.
SHARE = 80
#: Part of a set's size by which hash-order prefixes are longer, and share more.
EXTRA = 20
#: Classes that meet in a token and are all compared with each other.
BUCKET = 24
#: Pivots of the rounds in which larger groups are connected.
PIVOTS = (4, 32)
SLICE_BYTES = 1_000_000
#: Words of 64 bits in a parity bitmap, and in the bitmap of a further order's prefix.
PARITY_WORDS, ORDER_WORDS = 16, 8
#: Odd factors that make further orders of the token hashes.
ORDERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Sets with a possible partner up to which their keys are broadcast, about 40 MB. More are joined by a shuffle.
BROADCAST_ROWS = 300_000


def least_shared(n: int) -> int:
    """Tokens of a set of n that a similar set has too, at least."""
    return -(-SHARE * n // 100)


def extra(n: int) -> int:
    return max(1, n // EXTRA)


def prefix_size(n: int) -> int:
    """Size of a hash-order prefix in which similar sets share extra() tokens."""
    return n - least_shared(n) + extra(n)


def needed(n: int) -> int:
    """Tokens that a set of n shares with a similar one in both hash-order prefixes, at least."""
    return min(extra(n), extra(least_shared(n)))


def token_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct 5-word shingles; of all words where there are fewer than five."""
    numbers, distinct, bounds = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    hashes = word_hashes(distinct)[numbers] if len(numbers) else np.zeros(0, np.uint64)
    grams, out = gram_hashes(hashes, GRAM), []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= GRAM:
            out.append(np.unique(grams[a : b - GRAM + 1]))
        else:
            out.append(gram_hashes(np.concatenate([hashes[a:b], np.full(GRAM - (b - a), np.uint64(b - a))]), GRAM)[:1] if b > a else hashes[:0])
    return out


def set_key(tokens: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest(), np.int64).tolist())


def parity(tokens: np.ndarray) -> np.ndarray:
    """The bitmap in which every token of the set has flipped the bit of its low bits."""
    bits = 64 * PARITY_WORDS
    flips = np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.int64)


def order_bits(tokens: np.ndarray) -> np.ndarray:
    """For each further order a bitmap of the set's prefix; similar sets' bitmaps meet in every one."""
    out, bits, size = [], 64 * ORDER_WORDS, len(tokens) - least_shared(len(tokens)) + 1
    for factor in ORDERS:
        mixed = tokens * np.uint64(factor)
        first = np.partition(mixed, size - 1)[:size] if size < len(mixed) else mixed
        flags = np.zeros(bits, np.uint8)
        flags[(first % np.uint64(bits - 1)).astype(np.int64)] = 1
        out.append(np.packbits(flags).view(np.int64))
    return np.concatenate(out)


def _mapped(docs: DataFrame, columns: list[str], make, schema: str) -> DataFrame:
    """mapInArrow over slices of (text, columns...): make(slice, sets) gives the columns of a batch."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, SLICE_BYTES):
                yield pa.RecordBatch.from_arrays(make(part, token_sets(part.column(0))), names)

    return in_small_batches(docs).select("text", *columns).mapInArrow(lean(run), schema)


def _described(rows: DataFrame) -> DataFrame:
    """doc_id, mark, h1, h2, n of every row: the key of its set, and the set's size."""

    def make(part: pa.RecordBatch, sets: list[np.ndarray]) -> list[pa.Array]:
        keys = [set_key(s) for s in sets]
        return [part.column(1), part.column(2), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([len(s) for s in sets], pa.int64())]

    return _mapped(rows, ["doc_id", "mark"], make, "doc_id long, mark long, h1 long, h2 long, n long")


def _prefixes(rows: DataFrame) -> DataFrame:
    """(token, h1) of every hash-order prefix."""

    def make(part: pa.RecordBatch, sets: list[np.ndarray]) -> list[pa.Array]:
        sizes = [prefix_size(len(s)) if len(s) else 0 for s in sets]
        own = np.repeat(np.array([set_key(s)[0] for s in sets], np.int64), sizes)
        return [pa.array(np.concatenate([s[:k] for s, k in zip(sets, sizes, strict=True)]).view(np.int64)), pa.array(own)]

    return _mapped(rows, [], make, "token long, h1 long")


def _sets(rows: DataFrame) -> DataFrame:
    """sid, n, tokens, bits, head, need: whole sets, their bitmaps, their prefix's size and what similar ones share of it."""

    def make(part: pa.RecordBatch, sets: list[np.ndarray]) -> list[pa.Array]:
        sizes = [len(s) for s in sets]
        bits = [np.concatenate([parity(s), order_bits(s)]) for s in sets]
        return [part.column(1), pa.array(sizes, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())), pa.array(map(prefix_size, sizes), pa.int32()), pa.array(map(needed, sizes), pa.int32())]

    return _mapped(rows, ["sid"], make, "sid long, n long, tokens array<long>, bits array<long>, head int, need int")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The links among pairs (a, b) of set ids, by all filters and then whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            x, y = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                s, t = (np.asarray(c[i].values).view(np.uint64) for c in (x, y))
                head = np.intersect1d(s[: prefix_size(len(s))], t[: prefix_size(len(t))], assume_unique=True)
                if len(head) >= min(needed(len(s)), needed(len(t))):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    keep[i] = 100 * both >= SHARE * (len(s) + len(t) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    bitmaps = lambda end: sets.select(F.col("sid").alias(end), F.col("n").alias(f"n{end}"), F.col("bits").alias(f"p{end}"))
    near = pairs.join(bitmaps("b"), "b").join(bitmaps("a"), "a").filter(_close_bitmaps("pa", "pb", "na", "nb")).select("a", "b")
    left = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("sid").alias("b"), F.col("tokens").alias("tb"))
    whole = near.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
    return materialise(in_small_batches(whole).mapInArrow(lean(run), "a long, b long"), "verified-links")


def _close_sizes(a: str, b: str) -> Column:
    return (F.col(a) * 100 >= F.col(b) * SHARE) & (F.col(b) * 100 >= F.col(a) * SHARE)


def _close_bitmaps(p: str, q: str, n: str, m: str) -> Column:
    """Whether the prefixes of every further order can meet, and parities differ in no more bits than similar sets of these sizes can in tokens."""
    total = F.col(n) + F.col(m)
    differ = sum((F.bit_count(F.col(p)[k].bitwiseXOR(F.col(q)[k])) for k in range(PARITY_WORDS)), F.lit(0))
    close = differ <= total - 2 * F.ceil(total * SHARE / (100 + SHARE))
    for first in range(PARITY_WORDS, PARITY_WORDS + len(ORDERS) * ORDER_WORDS, ORDER_WORDS):
        close &= reduce(Column.__or__, (F.col(p)[k].bitwiseAND(F.col(q)[k]) != 0 for k in range(first, first + ORDER_WORDS)))
    return close


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """id, component after more links: the components so far are the vertices, so only the new links are worked on."""
    ends = links
    for end in ("a", "b"):
        own = labels.select(F.col("id").alias(end), "component")
        ends = ends.join(own, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    up = components(ends.filter("a <> b").distinct())
    moved = labels.join(up.select(F.col("id").alias("component"), F.col("component").alias("root")), "component", "left").select("id", F.coalesce("root", "component").alias("component"))
    return materialise(moved.unionByName(up.join(labels, "id", "left_anti")), "labels")


def _meeting(sets: DataFrame, name: str) -> DataFrame:
    """token, sid, n, alone of the rarest-first prefixes of `tokens`, from sets (sid, n, tokens, need) that share `need` of them with a similar one at least.

    alone: how many of the tokens no other set has. They come first and can't meet.
    """
    rows = sets.select("sid", "n", "need", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    shared = rows.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    order = Window.partitionBy("sid").orderBy("df", "token")
    own = rows.join(shared, "token").withColumns({"rank": F.row_number().over(order), "shared": F.count("*").over(Window.partitionBy("sid"))})
    first = own.filter(F.col("rank") <= F.col("shared") - F.col("need") + 1)
    return materialise(first.select("token", "sid", "n", (F.col("size") - F.col("shared")).alias("alone")), name)


def _groups(meeting: DataFrame, name: str) -> DataFrame:
    """token, size: of tokens with the same sets, which make the same pairs, one."""
    hashed = F.xxhash64("sid")
    groups = meeting.groupBy("token").agg(F.count("*").alias("size"), F.bit_xor(hashed).alias("h1"), F.bit_xor(F.xxhash64(hashed, F.lit(1))).alias("h2")).filter("size > 1")
    return materialise(groups.groupBy("size", "h1", "h2").agg(F.min("token").alias("token")).select("token", "size"), name)


def _small_pairs(meeting: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (a, b) of close sizes in tokens with up to BUCKET sets."""
    member = F.struct("sid", "n")
    small = meeting.join(groups.filter(F.col("size") <= BUCKET), "token").groupBy("token").agg(F.array_sort(F.collect_list(member)).alias("all"))
    small = small.select("all").withColumn("x", F.explode("all")).withColumn("y", F.explode(F.filter("all", lambda m: m["sid"] > F.col("x.sid"))))
    return small.filter(_close_sizes("x.n", "y.n")).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"))


def _crowded(groups: DataFrame) -> DataFrame:
    return groups.filter(F.col("size") > BUCKET).select("token")


def _labels(sets: DataFrame, links: DataFrame) -> DataFrame:
    """id, component of the sets that any similar set, or one of `links`, is linked with."""
    meeting = _meeting(sets.withColumn("tokens", F.slice("tokens", 1, F.col("head"))), "meeting-tokens")
    groups = _groups(meeting, "token-groups")
    again = sets.join(meeting.join(_crowded(groups), "token").select("sid").distinct(), "sid", "left_semi")
    crowd = _meeting(again.withColumn("need", F.ceil(F.col("n") * SHARE / 100)), "meeting-crowds")
    crowd_groups = _groups(crowd, "crowd-groups")
    pairs = _small_pairs(meeting, groups).unionByName(_small_pairs(crowd, crowd_groups)).distinct()
    labels = components(_verified(pairs, sets).unionByName(links))
    discard(meeting)
    release(sets.sparkSession)
    crowds = crowd.join(_crowded(crowd_groups), "token").join(sets.select("sid", "bits"), "sid")
    crowds = materialise(crowds.select("token", "sid", "n", "alone", "bits"), "crowded-tokens")
    for pivots in (*PIVOTS, None):
        own = crowds.join(labels.withColumnRenamed("id", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
        parts = own.groupBy("token", "component").agg(F.count("*").alias("size"))
        main = parts.groupBy("token").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")
        open_ = materialise(own.join(main, "token"), "open-tokens")
        discard(crowds)
        if not open_.limit(1).count():
            break
        crowds = open_.select("token", "sid", "n", "alone", "bits")
        loose = open_ if pivots else open_.filter("component <> main")
        loose = loose.select("token", F.col("sid").alias("x"), F.col("n").alias("nx"), F.col("component").alias("cx"), F.col("bits").alias("px"))
        others = open_.select("token", F.col("sid").alias("y"), F.col("n").alias("ny"), F.col("component").alias("cy"), F.col("bits").alias("py"), "alone")
        if pivots:  # the sets with the fewest tokens of their own are the likeliest originals
            central = Window.partitionBy("token").orderBy("alone", "y")
            others = others.withColumn("rank", F.row_number().over(central)).filter(F.col("rank") <= pivots)
        close = loose.join(others, "token").filter((F.col("cx") != F.col("cy")) & _close_sizes("nx", "ny") & _close_bitmaps("px", "py", "nx", "ny"))
        found = _verified(close.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), sets)
        if found.limit(1).count():
            labels = _joined(labels, found)
        release(sets.sparkSession)
    return labels


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    component_id is the smallest id reachable by links, the row's own included.
    Texts without words, null texts among them, have an empty set and no links.
    Texts with fewer than five words have one shingle, all of their words. Rows
    without an id have no links and a null component_id. Repeated rows and equal
    sets are in one component, and so are rows of one id with different texts.
    Other columns aren't read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("mark", F.xxhash64("text"))
    described = materialise(_described(rows), "described")
    named = described.filter("doc_id IS NOT NULL AND n > 0")
    # a set's representative is a row of its smallest id; its number stands for the set from here on
    classes = named.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "mark")).alias("low"), F.max("n").alias("n"), F.count("*").alias("copies"))
    classes = materialise(classes.select("h1", "h2", "n", "copies", F.col("low.doc_id").alias("doc_id"), F.col("low.mark").alias("mark"), F.monotonically_increasing_id().alias("sid")), "classes")
    readable = rows.filter("doc_id IS NOT NULL AND text IS NOT NULL")
    tokens = _prefixes(readable).groupBy("token").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).filter("low < high").select("token")
    tokens = materialise(tokens, "shared-tokens")
    release(spark)
    counts = _prefixes(readable).join(tokens, "token", "left_semi").groupBy("h1").agg(F.count("*").alias("shared"))
    extra_of = lambda n: F.greatest(F.lit(1), F.floor(n / EXTRA))
    need = F.least(extra_of(F.col("n")), extra_of(F.ceil(F.col("n") * SHARE / 100)))
    # counts are those of all copies of a set
    survivors = classes.join(counts, "h1").filter(F.col("shared") >= need * F.col("copies")).select("doc_id", "mark", "sid")
    survivors = materialise(survivors, "survivors")
    discard(tokens)
    release(spark)
    few = survivors.count() <= BROADCAST_ROWS
    chosen = readable.join(F.broadcast(survivors) if few else survivors, ["doc_id", "mark"])
    sets = _sets(chosen)
    if described.groupBy("doc_id", "mark").agg(F.count("*").alias("rows")).filter("rows > 1").limit(1).count():  # repeated rows
        sets = sets.dropDuplicates(["sid"])
    sets = materialise(sets, "sets")
    release(spark)
    own = named.select("doc_id", "h1", "h2").join(classes.select("h1", "h2", "sid"), ["h1", "h2"]).select("doc_id", "sid")
    split = own.groupBy("doc_id").agg(F.min("sid").alias("a"), F.max("sid").alias("b")).filter("a < b")
    links = own.join(split, "doc_id").filter("sid > a").select("a", F.col("sid").alias("b"))
    labels = _labels(sets, links)
    discard(sets)
    members = classes.join(labels.withColumnRenamed("id", "sid"), "sid", "left").select("h1", "h2", "doc_id", F.coalesce("component", "sid").alias("component"))
    least = members.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    members = members.join(least, "component").select("h1", "h2", "component_id")
    return described.join(members, ["h1", "h2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("doc_id"))).alias("component_id")
    )


def distinct_documents(docs: DataFrame) -> DataFrame:
    """`docs` with the row of the smallest id of each component. Rows without an id all stay.

    Of several rows of that id the one with the longest text stays, then the
    first text; of equal texts, the row whose columns have the least hash.
    """
    keep = similar_documents(docs).filter("doc_id = component_id").select(F.col("doc_id").alias("keep")).distinct()
    # the row itself is one column, so that no name of its columns can clash; as JSON any column has a hash
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.select(row.alias("row"), F.col("doc_id").alias("id"), F.col("text").alias("words"))
    first = Window.partitionBy("id").orderBy(F.length("words").desc_nulls_last(), "words", F.xxhash64(F.to_json("row")))
    rows = packed.filter("id IS NOT NULL").join(keep, F.col("id").cast("long") == F.col("keep"), "left_semi").withColumn("n", F.row_number().over(first)).filter("n = 1")
    return rows.select("row.*").unionByName(docs.filter("doc_id IS NULL"))
