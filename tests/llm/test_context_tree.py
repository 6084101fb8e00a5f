"""Context-tree weighting against a recursion over single nodes."""

import gc
import math
import random
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import context_tree
from brindle.llm.common import BATCH_SETTING
from brindle.llm.context_tree import DEPTH
from tests.llm.helpers import AWKWARD, documents, residue, sentence, words


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def seen_as(text):
    return " ".join(words(lower(text))).encode() + b"\n"


def contexts(data):
    padded = b"\0" * DEPTH + data
    return [(padded[k : k + DEPTH], padded[k + DEPTH]) for k in range(len(data))]


def model(training):
    counts = Counter()
    for data in training:
        for context, byte in contexts(data):
            for depth in range(DEPTH + 1):
                for bit in range(8):
                    counts[context[DEPTH - depth :], bit, byte >> (8 - bit), (byte >> (7 - bit)) & 1] += 1
    children = {}
    for context, bit, prefix, _ in counts:
        if context:
            children.setdefault((context[1:], bit, prefix), set()).add(context)

    def kt(zeros, ones):
        return math.lgamma(zeros + 0.5) + math.lgamma(ones + 0.5) - math.lgamma(zeros + ones + 1) - math.log(math.pi)

    @lru_cache(None)
    def node(context, bit, prefix):
        zeros, ones = (counts[context, bit, prefix, v] for v in (0, 1))
        own = kt(zeros, ones)
        if len(context) == DEPTH:
            return zeros, ones, own, 1.0
        below = sum(node(c, bit, prefix)[2] for c in children.get((context, bit, prefix), ()))
        weighted = float(np.logaddexp(own, below)) + math.log(0.5)
        return zeros, ones, weighted, math.exp(own + math.log(0.5) - weighted)

    def log10(data):
        total = 0.0
        for context, byte in contexts(data):
            for bit in range(8):
                prefix, p = byte >> (8 - bit), None
                for depth in range(DEPTH, -1, -1):
                    zeros, ones, _, weight = node(context[DEPTH - depth :], bit, prefix)
                    mine = (ones + 0.5) / (zeros + ones + 1)
                    p = mine if p is None else weight * mine + (1 - weight) * p
                total += math.log10(p if (byte >> (7 - bit)) & 1 else 1 - p)
        return total

    return log10


def brute(rows):
    training = [t for i, t in rows if i is not None and residue(i, 10) != 0]
    log10 = model([seen_as(t) for t in training])
    counts = Counter(w for t in training for w in [*words(lower(t)), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        tokens = [*words(lower(t)), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        out.append((i, i is not None and residue(i, 10) == 0, len(tokens), sum(counts[w] > 0 for w in tokens), n, base, log10(seen_as(t))))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[-1]))


def scored(spark, rows, clashing=False):
    got = context_tree.score_documents(documents(spark, rows, clashing)).collect()
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=lambda r: (r[0] is not None, r[0] or 0, r[-1]))


def same(got, want):
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def test_scores_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, sentence(rng, rng.randrange(1, 40), 60).title()) for i in range(40)] + AWKWARD + [(1, "Repeated id"), (50, "naïve Ünicode é 日本語 \x00\x00"), (51, "A" * 500)]
    same(scored(spark, rows, clashing=True), brute(rows))


def test_many_groups(spark, monkeypatch):
    """Small slices, pieces and blocks of contexts give the same values."""
    monkeypatch.setattr(context_tree, "SLICE_BYTES", 500)
    monkeypatch.setattr(context_tree, "PIECE_BYTES", 60)
    monkeypatch.setattr(context_tree, "BLOCK_ROWS", 50)
    monkeypatch.setattr(context_tree, "HELD_KEYS", 80)
    rng = random.Random(2)
    rows = [(i, sentence(rng, rng.randrange(0, 30), 30)) for i in range(60)]
    rows += [(70, "  " + "long word " * 60 + " " * 200 + "x" * 150 + " \t\n end  "), (71, " " * 300), (72, "y" * 400)]
    rows += [(None, "no id, a text of one length")] * 9 + [(73, "repeated row")] * 9
    same(scored(spark, rows), brute(rows))


def test_very_long_text(spark):
    """A text of several slices' size between short ones."""
    rng = random.Random(3)
    rows = [(1, "short one"), (2, sentence(rng, 2_000_000, 40)), (3, "short two")]
    got = {r[0]: r for r in scored(spark, rows)}
    assert got[2][2] == 2_000_001 and got[2][4] == sum(r[2] for r in got.values() if not r[1])
    assert got[2][6] / got[2][2] > -4.2  # log10 of 40 words is 1.6, their spelling costs little more


def test_code_length(spark):
    rows = [(i, "the same words again and again") for i in range(30)]
    got = context_tree.score_documents(documents(spark, rows)).collect()
    assert all(r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / 31) and r.bits_per_byte < 1.5 for r in got)


@pytest.mark.parametrize("rows", [[], [(None, "no training rows")], [(next(i for i in range(99) if residue(i, 10) == 0), "held out")]])
def test_little_or_no_training(spark, rows):
    same(scored(spark, rows), brute(rows))


def test_probabilities_sum_to_one():
    seen = np.array([(7 << 8) | 65, (7 << 8) | 66, (9 << 8) | 65], np.uint64)
    every = (np.uint64(7) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
    levels = context_tree.grow(np.concatenate([seen, every]), np.array([3, 1, 2] + [0] * 256), range(DEPTH + 1))
    assert (10 ** context_tree.log10_of(context_tree.bit_probabilities(levels, every), every)).sum() == pytest.approx(1)


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 2.5, 7.9, 8.0, 100.5, 1e6 + 0.5])
    assert context_tree.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-10, abs=1e-10)


def test_values_of_a_slice_keep_no_batches():
    """Before a slice's texts come, its values are held alone, not the batches that they came in with their other columns."""
    n, held = 20_000, []

    def batch(kind, keys, text):
        m = len(keys)
        nulls = [None] * m
        columns = [
            pa.array([0] * m, pa.int32()), pa.array([kind] * m, pa.int32()), pa.array(keys, pa.int64()), pa.array([-1.0] * m), pa.array([1] * m, pa.int32()),
            pa.array([7] * m if text else nulls, pa.int64()), pa.array([False] * m if text else nulls, pa.bool_()), pa.array(text or nulls, pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["slice", "kind", "key", "value", "known", "doc_id", "held_out", "text"])

    def batches():
        before = pa.total_allocated_bytes()
        keys = np.unique(np.concatenate([context_tree.context_keys([b"a b\n"])[0].view(np.int64), np.arange(1 << 40, (1 << 40) + 5 * n)]))
        for at in range(0, len(keys), n):
            yield batch(context_tree.CONTEXT, keys[at : at + n], None)
        yield batch(context_tree.WORD, np.sort(context_tree.word_hashes(pa.array(["a", "b", "\n"], pa.large_string())).view(np.int64)), None)
        gc.collect()
        held.append(pa.total_allocated_bytes() - before)
        yield batch(context_tree.TEXT, [0], ["a b"])

    (got,) = list(context_tree._scores(batches()))
    assert got.to_pylist() == [{"doc_id": 7, "held_out": False, "n_tokens": 3, "n_known": 3, "n_bytes": 4, "base_score": -3.0, "score": -4.0}]
    assert held[0] < 100_000


def test_texts_come_in_small_batches(spark):
    """A batch of texts lies in the executor's JVM and in the worker at once, so score_documents sets a limit."""
    before = spark.conf.get(BATCH_SETTING, None)
    spark.conf.unset(BATCH_SETTING)
    try:
        context_tree.score_documents(documents(spark, [(1, "a b")])).collect()
        assert int(spark.conf.get(BATCH_SETTING)) <= 4_000_000
    finally:
        spark.conf.set(BATCH_SETTING, before) if before else spark.conf.unset(BATCH_SETTING)
