"""Phrases of two to four words that occur more often than their parts explain.

Texts become streams of word numbers with a break between pieces. Words that
occur too seldom to be in any phrase break the streams, too; the rest get
numbers of 32 bits, so that the four words from any place on are one key of 128 bits.
Each place gives one key: sorted keys hold the counts of all their prefixes as
lengths of runs. Slices sort and count their own keys by radix, keys are dealt
to ranges, sorted, and counted run by run. Nothing that grows with the corpus is
broadcast: a slice gets the numbers of its own words by a join.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm.common import discard, materialise, text_bytes

#: Bytes of text of one language that make a slice; a slice's words and keys are in memory at once.
SLICE_BYTES = 4_000_000
#: Keys that a range has on average.
RANGE_ROWS = 1_000_000
MOST_RANGES = 20_000
#: Bounded sample from which the ranges' limits are taken: slices, and keys of each. It decides where keys are counted, not how.
SAMPLED_SLICES, SAMPLED_KEYS = 64, 4096
LONGEST = 4

_SPACE, _BREAK = 1, 2
CLASSES = np.zeros(256, np.uint8)
CLASSES[[32, 9]] = _SPACE
CLASSES[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = _BREAK
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def piece_words(data: np.ndarray, bounds: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of texts, lower-cased, one after the other, and whether each begins a piece."""
    classes = CLASSES[data]
    word, first = classes == 0, np.zeros(len(data) + 1, bool)
    first[bounds] = True
    starts = np.flatnonzero(word & (np.r_[True, ~word[:-1]] | first[:-1])) if len(word) else np.zeros(0, np.int64)
    ends = np.flatnonzero(word & (np.r_[~word[1:], True] | first[1:])) + 1 if len(word) else starts
    cuts = np.cumsum((classes == _BREAK) | first[:-1], dtype=np.int32)[starts] if len(word) else np.zeros(0, np.int32)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    letters = LOWER[data[word]]
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return words, np.r_[True, cuts[1:] != cuts[:-1]] if len(cuts) else np.zeros(0, bool)


def _chunks(data: np.ndarray, bounds: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts in chunks of about `size` bytes; a longer text is cut after the next character that ends a piece."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        here = bounds[np.searchsorted(bounds, end, "left")] if end < len(data) else end  # the next text's begin
        if here > end + size // 4:
            for k in range(end, here, 65_536):
                found = np.flatnonzero(CLASSES[data[k : min(k + 65_536, here)]] == _BREAK)
                if len(found):
                    here = k + int(found[0]) + 1
                    break
        inside = bounds[(bounds > at) & (bounds < here)]
        yield data[at:here], np.concatenate([[at], inside, [here]]) - at
        at = int(here)


def streams(docs: DataFrame, text: str = "text", lang: str = "lang", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """slice, lang, words (each once), counts, stream: the words' places + 1 as 32-bit numbers, 0 between pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            for k, name in enumerate(coded.dictionary.to_pylist()):
                data, bounds = text_bytes(batch.column(1).filter(pc.equal(coded.indices, k)))
                for part, own in _chunks(data, bounds, slice_bytes):
                    words, begins = piece_words(part, own)
                    if not len(words):
                        continue
                    found = words.dictionary_encode()
                    numbers = found.indices.to_numpy()
                    stream = np.zeros(len(numbers) + int(begins.sum()), np.uint32)
                    stream[np.arange(len(numbers)) + np.cumsum(begins)] = numbers + 1
                    counts = np.bincount(numbers, minlength=len(found.dictionary))
                    yield pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([name]), pa.array([found.dictionary.to_pylist()], pa.list_(pa.string())), pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([stream.tobytes()], pa.binary())], names=["slice", "lang", "words", "counts", "stream"])

    columns = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    return columns.mapInArrow(run, "slice string, lang string, words array<string>, counts array<long>, stream binary")


def dictionary(coded: DataFrame, least: int) -> DataFrame:
    """lang, word, f, id of the words that occur `least` times or more; ids go on from one partition to the next."""
    each = coded.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x"))
    words = each.groupBy("lang", F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("f")).filter(F.col("f") >= least)
    kept = materialise(words.withColumn("at", F.monotonically_increasing_id()), "collocation-words")
    place, part = F.col("at").bitwiseAND(F.lit((1 << 33) - 1)), F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))  # a row a partition
    return kept.withColumn("part", part).join(F.broadcast(offsets), "part").select("lang", "word", "f", (F.col("offset") + place + 1).alias("id"))


def numbered(coded: DataFrame, words: DataFrame) -> DataFrame:
    """slice, stream, places, ids: the streams, and the numbers of those of the slice's words that have one."""
    own = coded.select("slice", "lang", F.posexplode("words").alias("place", "word")).join(words.select("lang", "word", "id"), ["lang", "word"])
    lists = own.groupBy("slice").agg(F.collect_list(F.struct("place", "id")).alias("x"))  # as many as a slice has words
    return coded.select("slice", "stream").join(lists.select("slice", F.col("x.place").alias("places"), F.col("x.id").alias("ids")), "slice")


def windows(stream: np.ndarray, places: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys (two 64-bit halves) of all places of a stream from which two words or more follow unbroken; zeros fill up."""
    table = np.zeros(int(stream.max(initial=0)) + 1, np.uint64)
    known = places + 1 < len(table)
    table[places[known] + 1] = ids[known]
    row = np.concatenate([table[stream], np.zeros(LONGEST, np.uint64)])
    n = len(stream)
    w = [row[:n]]
    for k in range(1, LONGEST):
        w.append(np.where(w[-1] > 0, row[k : n + k], 0))
    some = w[1] > 0
    w = [x[some] for x in w]
    return ((w[0] << np.uint64(32)) | w[1]).view(np.int64), ((w[2] << np.uint64(32)) | w[3]).view(np.int64)


def radix_order(*halves: np.ndarray) -> np.ndarray:
    """The order of keys, the first half first: a radix sort by digits of 16 bits from the last one on; equal digits are passed over."""
    order = None
    for half in reversed(halves):
        bits = half.view(np.uint64) ^ np.uint64(1 << 63)  # as signed numbers
        for shift in (0, 16, 32, 48):
            digit = ((bits >> np.uint64(shift)) & np.uint64(0xFFFF)).astype(np.uint16)
            if len(digit) and (digit == digit[0]).all():
                continue
            step = np.argsort(digit if order is None else digit[order], kind="stable")  # NumPy sorts 16-bit numbers by radix
            order = step if order is None else order[step]
    return np.arange(len(halves[0])) if order is None else order


def counted(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each is there."""
    order = radix_order(hi, lo)
    hi, lo = hi[order], lo[order]
    first = np.flatnonzero(np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]) if len(hi) else np.zeros(0, np.int64)
    return hi[first], lo[first], np.diff(np.r_[first, len(hi)])


def _slice_keys(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for stream, places, ids in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
        yield counted(*windows(np.frombuffer(stream.as_buffer(), np.uint32), places.values.to_numpy(), ids.values.to_numpy().astype(np.uint64)))


def _limits(coded: DataFrame, keyed: DataFrame, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that cut all keys into about equal ranges, from a bounded sample."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hi, lo, _ in _slice_keys(batch):
                at = np.linspace(0, len(hi) - 1, min(SAMPLED_KEYS, len(hi))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(hi[at]), pa.array(lo[at])], names=["hi", "lo"])

    chosen = [r[0] for r in coded.select("slice").orderBy(F.xxhash64("slice")).limit(SAMPLED_SLICES).collect()]
    sample = keyed.filter(F.col("slice").isin(chosen)).select("stream", "places", "ids").mapInArrow(some, "hi long, lo long").toPandas()
    hi, lo = sample["hi"].to_numpy(np.int64), sample["lo"].to_numpy(np.int64)
    order = radix_order(hi, lo)
    at = order[np.linspace(0, len(hi), min(ranges, max(1, len(hi))) + 1).astype(np.int64)[1:-1]]
    return counted(hi[at], lo[at])[:2]


def _places(hi: np.ndarray, lo: np.ndarray, limits: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The number of the range of each of the sorted keys."""
    low, high = np.searchsorted(hi, limits[0], "left"), np.searchsorted(hi, limits[0], "right")
    cuts = [a + int(np.searchsorted(lo[a:b], x, "left")) for a, b, x in zip(low.tolist(), high.tolist(), limits[1], strict=True)]
    return np.searchsorted(np.array(cuts, np.int64), np.arange(len(hi)), "right").astype(np.int32)


def run_lengths(batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The counts of all prefixes of two to four words, from sorted (range, hi, lo, n), as arrays (hi, lo, f).

    A run at a range's begin or end may go on in the next one, so it is given
    whatever its length; of others those with `least` or more are.
    """
    halves = lambda k, hi, lo: (hi, np.zeros_like(lo) if k == 2 else (lo >> 32) << 32 if k == 3 else lo)
    carried: dict[int, tuple | None] = {k: None for k in range(2, LONGEST + 1)}  # (range, hi, lo, f, whether it began its range)

    for part, hi, lo, n in batches:
        for k in carried:
            key_hi, key_lo = halves(k, hi, lo)
            real = slice(None) if k == 2 else ((lo >> 32) != 0 if k == 3 else (lo & 0xFFFFFFFF) != 0)
            p, a, b, c = part[real], key_hi[real], key_lo[real], n[real]
            if not len(p):
                continue
            firsts = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
            sums, p, a, b = np.add.reduceat(c, firsts), p[firsts], a[firsts], b[firsts]
            before = carried[k]
            edge = np.r_[True, p[1:] != p[:-1]]
            if before is not None:
                if before[:3] == (p[0], a[0], b[0]):
                    sums[0] += before[3]
                    edge[0] = before[4]
                else:
                    edge[0] = before[0] != p[0]
                    if before[4] or edge[0] or before[3] >= least:  # it ended its range, or is long enough
                        yield np.array([before[1]]), np.array([before[2]]), np.array([before[3]])
            carried[k] = (p[-1], a[-1], b[-1], sums[-1], bool(edge[-1]))
            out = edge | np.r_[p[1:] != p[:-1], False] | (sums >= least)
            out[-1] = False
            yield a[out], b[out], sums[out]
    for before in carried.values():
        if before is not None:
            yield np.array([before[1]]), np.array([before[2]]), np.array([before[3]])


def phrase_counts(coded: DataFrame, words: DataFrame, least: int) -> DataFrame:
    """hi, lo, f of all phrases of two to four words that occur `least` times or more."""
    keyed = numbered(coded, words)
    size = coded.agg(F.coalesce(F.sum(F.length("stream")), F.lit(0))).first()[0] // 4
    limits = _limits(coded, keyed, int(min(max(1, size // RANGE_ROWS), MOST_RANGES)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hi, lo, n in _slice_keys(batch):
                part = _places(hi, lo, limits)
                for at in range(0, len(hi), 100_000):
                    cut = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(part[cut]), pa.array(hi[cut]), pa.array(lo[cut]), pa.array(n[cut].astype(np.int32))], names=["part", "hi", "lo", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(batch.column(k).to_numpy().astype(np.int64) for k in range(4)) for batch in batches if batch.num_rows)
        for hi, lo, f in run_lengths(rows, least):
            yield pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(f, pa.int64())], names=["hi", "lo", "f"])

    keys = keyed.select("stream", "places", "ids").mapInArrow(deal, "part int, hi long, lo long, n int")
    dealt = keys.repartitionById(len(limits[0]) + 1, F.col("part")).sortWithinPartitions("part", "hi", "lo")
    return dealt.mapInArrow(count, "hi long, lo long, f long").groupBy("hi", "lo").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)


def _word(k: int) -> Column:
    """The number of a key's word k."""
    half = F.col("hi") if k < 2 else F.col("lo")
    return F.shiftright(half, 32).bitwiseAND(F.lit(0xFFFFFFFF)) if k % 2 == 0 else half.bitwiseAND(F.lit(0xFFFFFFFF))


def _key(words: list[Column]) -> Column:
    """struct(hi, lo) of up to four numbers."""
    w = [*words, *[F.lit(0).cast("long")] * (LONGEST - len(words))]
    return F.struct(F.shiftleft(w[0], 32).bitwiseOR(w[1]).alias("hi"), F.shiftleft(w[2], 32).bitwiseOR(w[3]).alias("lo"))


def _length() -> Column:
    return F.when(F.col("lo") == 0, 2).when(_word(3) == 0, 3).otherwise(4)


def scores(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """hi, lo, a, lang, l, r, score of every phrase by its weakest cut; equal ones fall to the first."""
    single = words.select(F.shiftleft("id", 32).alias("hi"), F.lit(0).cast("long").alias("lo"), "f", "lang")
    known = single.unionByName(phrases.withColumn("lang", F.lit(None).cast("string")))
    w = [_word(k) for k in range(LONGEST)]
    cut = lambda n: F.array(*[F.struct(F.lit(k).alias("k"), _key(w[:k]).alias("left"), _key(w[k:n]).alias("right")) for k in range(1, n)])
    cuts = F.when(_length() == 2, cut(2)).when(_length() == 3, cut(3)).otherwise(cut(4))
    each = phrases.select("hi", "lo", F.col("f").alias("a"), F.explode(cuts).alias("c")).select("hi", "lo", "a", "c.k", F.col("c.left.hi").alias("l_hi"), F.col("c.left.lo").alias("l_lo"), F.col("c.right.hi").alias("r_hi"), F.col("c.right.lo").alias("r_lo"))
    left = known.select(F.col("hi").alias("l_hi"), F.col("lo").alias("l_lo"), F.col("f").alias("l"), "lang")
    right = known.select(F.col("hi").alias("r_hi"), F.col("lo").alias("r_lo"), F.col("f").alias("r"))
    exact = F.expr("(CAST(a AS decimal(20, 0)) * 2000000) div CAST(l + r AS decimal(20, 0))")
    rated = each.join(left, ["l_hi", "l_lo"]).join(right, ["r_hi", "r_lo"]).withColumn("score", exact)
    best = rated.groupBy("hi", "lo", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"), F.max("lang").alias("lang"))  # the first cut's left part is a word, which has a language
    return best.select("hi", "lo", "a", "lang", "best.l", "best.r", "best.score")


def contained(phrases: DataFrame, share: int) -> DataFrame:
    """hi, lo, within: of phrases inside longer ones the greatest count of those."""
    w = [_word(k) for k in range(LONGEST)]
    inner = lambda n: F.array(*[_key(w[a:b]) for size in range(2, n) for a in range(n - size + 1) for b in [a + size]])
    longer = phrases.filter("lo <> 0")
    parts = longer.select("f", F.explode(F.when(_length() == 3, inner(3)).otherwise(inner(4))).alias("x"))
    return parts.groupBy(F.col("x.hi").alias("hi"), F.col("x.lo").alias("lo")).agg(F.max("f").alias("within"))


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, share: int = 80, text: str = "text", lang: str = "lang") -> DataFrame:
    """The first `top` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase has two to four words of one piece (between any of .,;:!? and line
    ends) and occurs a times, `least` or more. Of its cuts into two parts, with
    l and r occurrences, the one with the least score floor(2000000 a / (l + r)) counts.
    Phrases inside a longer one that occurs `share` percent as often or more are
    dropped. n is the number of all words of the language. Order: score, a, then
    the phrase by its UTF-8 bytes. Null texts are empty, null languages `und`;
    ids don't matter, so repeated rows and rows without an id count like others. Languages
    without a phrase have no row, an empty table gives none. Other columns are
    left out.
    """
    coded = materialise(streams(docs, text, lang), "collocation-streams")
    words = dictionary(coded, least)
    phrases = materialise(phrase_counts(coded, words, least), "collocation-phrases")
    rated = scores(phrases, words).join(contained(phrases, share), ["hi", "lo"], "left").filter(F.col("within").isNull() | (F.col("within") * 100 < F.col("a") * share))
    order = [F.col("score").desc(), F.col("a").desc()]
    first = materialise(rated.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("place") <= top).drop("place", "within"), "collocation-first")  # ties of the last place stay till their words are known
    spelled = first.select("hi", "lo", F.posexplode(F.filter(F.array(*[_word(k) for k in range(LONGEST)]), lambda x: x > 0)).alias("k", "id")).join(words.select("id", "word"), "id")
    phrase = spelled.groupBy("hi", "lo").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("k", "word"))), lambda x: x["word"])).alias("phrase"))
    sizes = coded.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    last = Window.partitionBy("lang").orderBy(*order, "phrase")
    ranked = first.join(phrase, ["hi", "lo"]).withColumn("rank", F.row_number().over(last).cast("long")).filter(F.col("rank") <= top)
    out = materialise(ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "collocations")
    for step in (coded, phrases, first):
        discard(step)
    return out
