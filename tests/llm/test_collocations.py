"""Collocations against counting by hand."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import collocations
from tests.llm.helpers import documents, rows_of

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(rows, least=30, top=2000, share=80):
    out = []
    langs = {r[2] if r[2] is not None else "und" for r in rows}
    for lang in langs:
        f, n = Counter(), 0
        for _, text, own, _ in rows:
            if (own if own is not None else "und") != lang:
                continue
            lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
            for piece in re.split("[.,;:!?\n-\r]", lower):
                words = re.findall("[^ \t]+", piece)
                n += len(words)
                for k in range(1, 5):
                    f.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
        phrases = {p: c for p, c in f.items() if len(p) > 1 and c >= least}
        kept = []
        for p, a in phrases.items():
            if any(100 * c >= share * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, c in phrases.items() if len(q) > len(p)):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def some_rows(seed=3, n=80):
    rng = random.Random(seed)
    words = ["The", "cat", "sat", "on", "mat", "é", "ß\x01", "ß", "a b", "x", "of", "\x1c"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " \x0b", "!"]
    text = lambda: "".join(rng.choice(words[: rng.randrange(2, 12)]) + rng.choice(marks) for _ in range(rng.randrange(60)))
    rows = [(i, text(), rng.choice(["en", "en", "de", None]), "s") for i in range(n)]
    return [*rows, (900, None, "en", "s"), (901, "", "fr", "s"), (902, "...", "fr", "s"), (None, "the cat sat on", "en", None), *[(903, "one two three four five", "de", "s")] * 31]


@pytest.mark.parametrize("slice_bytes", [4_000_000, 500])
def test_equals_counting_by_hand(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(collocations, "RANGE_ROWS", 150 if slice_bytes == 500 else 1_000_000)
    monkeypatch.setattr(collocations, "streams", lambda docs, text, lang, f=collocations.streams: f(docs, text, lang, slice_bytes))
    rows = some_rows()
    got = rows_of(collocations.collocations(documents(spark, rows, clashing=slice_bytes == 500).repartition(3), least=5), *COLUMNS)
    assert got == brute(rows, 5) and len(got) > 20
    if slice_bytes == 500:
        few = rows_of(collocations.collocations(documents(spark, rows), least=5, top=4, share=30), *COLUMNS)
        assert few == brute(rows, 5, 4, 30)


def test_nothing_gives_nothing(spark):
    assert collocations.collocations(documents(spark, []).limit(0)).count() == 0
    assert collocations.collocations(documents(spark, [(1, "a b", None, None), (2, None, "en", None)])).count() == 0


def test_long_texts_are_cut_after_pieces():
    text = ("one two three four. " * 300 + "tail " * 500).encode()
    data = np.frombuffer(text, np.uint8)
    bounds = np.array([0, len(text)])
    whole, begins = collocations.piece_words(data, bounds)
    parts = [collocations.piece_words(*c) for c in collocations._chunks(data, bounds, 700)]
    assert len(parts) > 3 and pa.chunked_array([p[0] for p in parts]).to_pylist() == whole.to_pylist()
    assert np.concatenate([p[1] for p in parts]).tolist() == begins.tolist()


def test_radix_order_is_the_order_of_signed_pairs():
    rng = np.random.default_rng(1)
    hi, lo = rng.integers(-3, 3, 500) << 40, rng.integers(-(2**62), 2**62, 500) // 2**60
    order = collocations.radix_order(hi, lo)
    assert list(zip(hi[order], lo[order], strict=True)) == sorted(zip(hi, lo, strict=True))
    assert collocations.radix_order(hi[:0], lo[:0]).tolist() == []


@pytest.mark.parametrize("batch", [1, 3, 1000])
def test_runs_over_batches_and_ranges(batch):
    rng = random.Random(batch)
    keys = sorted(((a << 32) | b, (c << 32) | (d if c else 0)) for a, b, c, d in ((rng.randrange(1, 4), rng.randrange(1, 3), rng.randrange(3), rng.randrange(3)) for _ in range(200)))
    rows = [(i // 37, hi, lo, 1 + i % 2) for i, (hi, lo) in enumerate(keys)]
    want = Counter()
    for _, hi, lo, n in rows:
        want[hi, 0] += n
        if lo >> 32:
            want[hi, lo >> 32 << 32] += n
        if lo & 0xFFFFFFFF:
            want[hi, lo] += n
    batches = (tuple(np.array(c, np.int64) for c in zip(*rows[k : k + batch], strict=True)) for k in range(0, len(rows), batch))
    got, seen = Counter(), 0
    for hi, lo, f in collocations.run_lengths(batches, 9):
        seen += len(hi)
        for a, b, c in zip(hi.tolist(), lo.tolist(), f.tolist(), strict=True):
            got[a, b] += c
    assert {k: v for k, v in got.items() if v >= 9} == {k: v for k, v in want.items() if v >= 9}
    assert seen < 80
