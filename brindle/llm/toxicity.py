"""Toxic passages as maximum-scoring segments of token log-odds.

Training counts in how many toxic and clean documents a word is. A word's log-odds has an
informative Dirichlet prior: pseudo-counts in proportion to the word's share of
all text, so rare words need evidence. Words whose log-odds is significantly
positive form the lexicon, together with word beginnings, for inflected forms
that training never saw. Every other word costs a fixed drift. Scoring finds all
maximal scoring segments of a document in linear time and calibrates the best
one by the extreme-value distribution of segments in clean text, given the
document's length: its decay follows from how often clean text has which score,
its scale is fitted on clean rows that the lexicon wasn't learned from. A
logistic curve, fitted on those rows, turns that into a probability.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import discard, held_out, in_small_batches, lean, lower_ascii, materialise, residue, slices, words_of

#: Most labelled rows of each class that the model is fitted on.
FIT_ROWS = 10_000
#: Dirichlet pseudo-counts, as a share of the counts, and the z-score and log-odds from which a token counts.
PRIOR, Z, LEAST = 0.05, 2.0, 3.0
#: What a word outside the lexicon costs.
DRIFT = 0.05
#: The highest score of a text without any lexicon word, however many of the labelled rows are toxic.
NO_EVIDENCE = 0.25
#: Letters of a word's beginning.
STEM = 4
EDGES = ".,;:!?()[]{}\"'|*_-"
#: Words a worker remembers; the cache is emptied when full.
CACHED_WORDS = 100_000
#: Bytes of text that are Python strings at once.
SLICE_BYTES = 2_000_000


@dataclass(frozen=True)
class Model:
    """lexicon and stems: token to score; lam, k: the extreme-value law; a, b: the logistic curve."""

    lexicon: dict[str, float]
    stems: dict[str, float]
    lam: float
    k: float
    a: float
    b: float


class _Scores(dict):
    """Word as it stands in a text to score, worked out once."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        w = token(word)
        score = self.model.lexicon.get(w)
        if score is None:
            score = self.model.stems.get(w[:STEM], -DRIFT) if len(w) > STEM else -DRIFT
        self[word] = score
        return score


def token(word: str) -> str:
    return lower_ascii(word).strip(EDGES)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) of a sequence, in order.

    One pass over the positive scores: `kept` holds the candidates so far with
    the cumulative totals before (left) and after (right) them. A new candidate
    is joined with the nearest earlier one whose left total is smaller if that
    one's right total is smaller too. `link` remembers the nearest one, which
    keeps the search linear.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    kept: list[tuple[int, int, float, float, int]] = []  # start, end, left, right, link
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, left, right = i, i + 1, float(total[i]), float(total[i + 1])
        j = len(kept) - 1
        while True:
            while j >= 0 and kept[j][2] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= right:
                break
            start, left = kept[j][0], kept[j][2]
            del kept[j:]
            j -= 1
        kept.append((start, end, left, right, j))
    return [(s, e, r - l) for s, e, l, r, _ in kept]


def surprise(best: float, n: int, lam: float, k: float) -> float:
    """-ln P(clean text of n words has a segment of this score or more); 0 without a segment."""
    if best <= 0:
        return 0.0
    expected = math.log(k * max(n, 1)) - lam * best
    if expected < -20:
        return min(-expected, 100.0)
    return min(-math.log(-math.expm1(-math.exp(min(expected, 50.0)))), 100.0)


def _scorer(model: Model):
    """A function from a text to its number of words and its maximal segments (start, end, score)."""
    scores = _Scores(model)

    def segments(text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        words = words_of(text)
        if len(scores) > CACHED_WORDS:
            scores.clear()
        values = [scores[w] for w in words]
        if not values or max(values) <= 0:
            return len(words), []
        return len(words), maximal_segments(np.array(values))

    return segments


def logit(model: Model, best: float, n: int) -> float:
    return model.a + model.b * surprise(best, n, model.lam, model.k)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, clean, toxic): in how many texts of a batch each token is, so that no text's repetitions sway it."""
    for batch in (part for whole in batches for part in slices(whole, 0, SLICE_BYTES)):
        counts = (Counter(), Counter())
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[toxic].update(set(map(token, words_of(text))))
        words = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in counts)], ["token", "clean", "toxic"])


def _known(labels: DataFrame, modulus: int) -> DataFrame:
    """doc_id, toxic of the labels outside the held-out rows, one row an id."""
    return labels.filter(F.col("toxic").isin(0, 1) & (residue(F.col("doc_id"), modulus) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def class_weights(labels: DataFrame, modulus: int, fit_rows: int) -> tuple[float, float]:
    """How many training labels a chosen row of the clean and of the toxic class stands for; 1 up to `fit_rows`."""
    n = {r["toxic"]: r["n"] for r in _known(labels, modulus).groupBy(F.col("toxic").cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return max(n.get(0, 0) / fit_rows, 1.0), max(n.get(1, 0) / fit_rows, 1.0)


def training_rows(docs: DataFrame, labels: DataFrame, modulus: int, fit_rows: int) -> DataFrame:
    """text, toxic and part (the residue) of at most `fit_rows` labelled documents of each class.

    Rows are chosen by a hash of the id. Labels other than 0 and 1 and rows
    without an id don't count; of repeated labels of one id, toxic wins.
    """
    known = _known(labels, modulus)
    order = F.xxhash64(F.col("doc_id"), F.lit(5))
    chosen = [known.filter(F.col("toxic") == c).orderBy(order, "doc_id").limit(fit_rows) for c in (0, 1)]
    bounded = chosen[0].unionByName(chosen[1])  # at most 2 * fit_rows ids
    rows = docs.select("doc_id", "text").join(F.broadcast(bounded), "doc_id")
    return rows.select("text", F.col("toxic").cast("int").alias("toxic"), residue(F.col("doc_id"), modulus).alias("part"))


def _log_odds(counts: DataFrame, weights: tuple[float, float], totals: tuple[float, float]) -> DataFrame:
    """Adds score, z and clean_share to (token, clean, toxic); pseudo-counts follow the weighted text."""
    clean_all, toxic_all = totals
    w0, w1 = weights
    pseudo = PRIOR * (clean_all + toxic_all)
    prior = pseudo * (F.col("clean") * F.lit(w0) + F.col("toxic") * F.lit(w1)) / F.lit(float(max(clean_all * w0 + toxic_all * w1, 1)))
    a, b = F.col("toxic") + prior, F.col("clean") + prior
    score = F.log(a / (F.lit(toxic_all + pseudo) - a)) - F.log(b / (F.lit(clean_all + pseudo) - b))
    return counts.select("token", score.alias("score"), (b / F.lit(clean_all + pseudo)).alias("clean_share"), (score / F.sqrt(1 / a + 1 / b)).alias("z"), "toxic")


def _significant(counts: DataFrame, weights: tuple[float, float], totals: tuple[float, float]) -> DataFrame:
    """The tokens whose log-odds is significantly positive; none without clean text."""
    known = counts.filter((F.col("token") != "") & F.lit(totals[0] > 0))
    return _log_odds(known, weights, totals).filter((F.col("toxic") > 0) & (F.col("z") > Z) & (F.col("score") > LEAST))


def _logistic(x: np.ndarray, y: np.ndarray, weights: tuple[float, float] = (1.0, 1.0)) -> tuple[float, float]:
    """Intercept and slope by Newton's method, with a weak ridge for separable data; rows count by their class's weight."""
    if len(set(y.tolist())) < 2:
        return (-4.0, 1.0)
    m = np.column_stack([np.ones_like(x), x])
    times = np.where(y > 0, weights[1], weights[0])
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-m @ w))
        grad = m.T @ (times * (p - y)) + 1e-2 * w
        hess = (m * (times * p * (1 - p))[:, None]).T @ m + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -5, 5)
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, modulus: int = 5, fit_rows: int = FIT_ROWS) -> Model:
    """The model of the labelled rows whose residue isn't 0.

    The lexicon comes from all residues but the last, the logistic curve from
    the last. What reaches the driver are significant tokens and one number a
    calibration row, both bounded by `fit_rows`. Rows of a class over that bound
    count for all labels of the class, so the bound doesn't change the rate of
    toxic rows. Without toxic or without clean
    rows the lexicon is empty and every score is low.
    """
    weights = class_weights(labels, modulus, fit_rows)
    rows = materialise(training_rows(docs, labels, modulus, fit_rows), "toxicity-rows")
    words = rows.filter(F.col("part") != modulus - 1).select("text", "toxic").mapInArrow(lean(_count_words), "token string, clean long, toxic long")
    counts = materialise(words.groupBy("token").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "toxicity-counts")
    totals = tuple(counts.agg(F.coalesce(F.sum("clean"), F.lit(0)), F.coalesce(F.sum("toxic"), F.lit(0))).first())
    found = {r["token"]: r for r in _significant(counts, weights, totals).collect()}
    stem_of = F.substring("token", 1, STEM).alias("token")
    by_stem = lambda df: df.filter(F.length("token") > STEM).groupBy(stem_of).agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    stems = {r["token"]: r["score"] for r in _significant(by_stem(counts), weights, totals).collect()}
    # a stem scores where the whole word isn't in the lexicon; its share of clean text is that of such words
    spark = docs.sparkSession
    whole, beginnings = (spark.createDataFrame([(t,) for t in names], "token string") for names in (found, stems))  # as many as significant tokens
    rest = by_stem(counts.join(F.broadcast(whole), "token", "left_anti")).join(F.broadcast(beginnings), "token")
    gains = sorted([(r["score"], r["clean_share"]) for r in found.values()] + [(stems[r["token"]], r["clean_share"]) for r in _log_odds(rest, weights, totals).collect()])
    model = Model({t: r["score"] for t, r in found.items()}, stems, _decay(gains), 1.0, -4.0, 1.0)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments = _scorer(model)
        for batch in (part for whole in batches for part in slices(whole, 0, SLICE_BYTES)):
            all_found = [segments(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([max((v for _, _, v in f), default=0.0) for _, f in all_found], pa.float64()), pa.array([n for n, _ in all_found], pa.int64()), batch.column(1)], ["best", "n", "toxic"])

    # sorted, as sums of doubles depend on the order in which rows arrive
    pairs = sorted(rows.filter(F.col("part") == modulus - 1).select("text", "toxic").mapInArrow(lean(best), "best double, n long, toxic int").collect())
    clean = [(r["best"], r["n"]) for r in pairs if not r["toxic"]]
    k = scale(clean, model.lam)
    x = np.array([surprise(r["best"], r["n"], model.lam, k) for r in pairs], float)
    a, b = _logistic(x, np.array([r["toxic"] for r in pairs], float), weights)
    discard(rows)
    discard(counts)
    return Model(model.lexicon, stems, model.lam, k, min(a, math.log(NO_EVIDENCE / (1 - NO_EVIDENCE))), b)


def _decay(gains: list[tuple[float, float]]) -> float:
    """lambda of the extreme-value law: where a word's score in clean text has the mean of exp(lambda * score) equal to 1, from (score, share) of all that gains."""
    hit = min(sum(p for _, p in gains), 0.5)

    def excess(lam: float) -> float:
        return sum(p * math.exp(min(lam * s, 500.0)) for s, p in gains) + (1 - hit) * math.exp(-lam * DRIFT) - 1

    low, high = 1e-3, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        low, high = (mid, high) if excess(mid := (low + high) / 2) < 0 else (low, mid)
    return (low + high) / 2


def scale(clean: list[tuple[float, int]], lam: float) -> float:
    """K of the law, by greatest likelihood from (best score, words) of clean rows: K n exp(-lambda best) is exponential with mean 1."""
    total = sum(max(n, 1) * math.exp(-lam * best) for best, n in clean)
    return max(len(clean) / total, 1e-9) if total > 0 else 1.0


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, passages of every row.

    `passages` lists the maximal segments whose own surprise reaches the point
    where the score is one half: first word, word after the last, log-odds sum.
    Every occurrence of a token counts; that texts repeat their words is in the
    training counts, which are of documents, and in the law fitted on clean rows.
    Null and empty texts have no passages and the score of a text without any
    lexicon word. Repeated rows get equal scores; other columns are not read.
    """
    kind = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("log_odds", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _scorer(model)
        for batch in (part for whole in batches for part in slices(whole, 1, SLICE_BYTES)):
            scores, passages = [], []
            for text in batch.column(1).to_pylist():
                n, found = one(text)
                x = logit(model, max((v for _, _, v in found), default=0.0), n)
                scores.append(1 / (1 + math.exp(-max(-50.0, min(50.0, x)))))
                passages.append([{"start": s, "end": e, "log_odds": v} for s, e, v in found if logit(model, v, n) >= 0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(passages, pa.list_(kind))], ["doc_id", "score", "predicted", "passages"])

    return in_small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, score double, predicted int, passages array<struct<start: long, end: long, log_odds: double>>")


def clean_documents(docs: DataFrame, labels: DataFrame, modulus: int = 5) -> DataFrame:
    """`docs` without the rows that the model takes for toxic, columns unchanged."""
    model = fit(docs, labels, modulus)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _scorer(model)
        for batch in (part for whole in batches for part in slices(whole, at, SLICE_BYTES)):
            every = [one(t) for t in batch.column(at).to_pylist()]
            mask = [logit(model, max((v for _, _, v in found), default=0.0), n) < 0 for n, found in every]
            yield batch.filter(pa.array(mask, pa.bool_()))

    at = docs.columns.index("text")
    return in_small_batches(docs).mapInArrow(lean(keep), docs.schema)


def scored_query(docs: DataFrame, labels: DataFrame, modulus: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages of all documents."""
    return score(docs, fit(docs, labels, modulus)).select("doc_id", held_out(F.col("doc_id"), modulus).alias("held_out"), "score", "predicted", F.size("passages").alias("n_passages"))
