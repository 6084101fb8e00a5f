"""Removal of repeated passages against looking at every window."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import substring_dedup
from tests.llm.helpers import AWKWARD, documents, rows_of, sentence, words

COLUMNS = ("doc_id", "n_words", "n_removed", "kept_sha256")


def brute(rows, window=13):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - window + 1):
            owner = first.get(tuple(w[k : k + window]))
            if i is not None and owner is not None and owner < i:
                gone.update(range(k, k + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=lambda r: [(v is not None, v) for v in r])


def passages(seed, n=60):
    rng = random.Random(seed)
    shared = [sentence(rng, k) for k in (12, 13, 14, 20, 60, 200)]
    rows = []
    for i in range(n):
        parts = [sentence(rng, rng.randrange(1, 40))]
        for _ in range(rng.randrange(4)):
            own = rng.choice(shared).split()
            a = rng.randrange(0, max(1, len(own) - 12))
            parts += [" ".join(own[a : a + rng.randrange(10, 60)]), sentence(rng, rng.randrange(0, 20))]
        rows.append((i, "\n".join(parts)))
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    rows = passages(1) + AWKWARD
    assert rows_of(substring_dedup.remove_repeats(documents(spark, rows, clashing=True)), *COLUMNS) == brute(rows)


def test_few_words(spark):
    """Texts over two words repeat themselves and each other all the time."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(5, 90)))) for i in range(40)] + [(50, "a " * 300), (51, "a " * 40), (3, "a " * 40)]
    assert rows_of(substring_dedup.remove_repeats(documents(spark, rows)), *COLUMNS) == brute(rows)


def test_crowded_anchors_are_grouped(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CROWDED", 1)
    rows = passages(3)
    assert rows_of(substring_dedup.remove_repeats(documents(spark, rows)), *COLUMNS) == brute(rows)


def test_small_shards(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SHARD_REGIONS", 2)
    rows = passages(4)
    assert rows_of(substring_dedup.remove_repeats(documents(spark, rows)), *COLUMNS) == brute(rows)


def test_long_text(spark):
    base = sentence(random.Random(5), 60_000, 10**6)
    rows = [(1, base), (2, "start " + base + " end"), (3, base[: len(base) // 2])]
    assert rows_of(substring_dedup.remove_repeats(documents(spark, rows)), *COLUMNS) == brute(rows)


@given(st.lists(st.lists(st.integers(0, 2), min_size=1, max_size=14), min_size=1, max_size=5), st.lists(st.integers(0, 2), max_size=20))
@settings(max_examples=80, deadline=None)
def test_automaton_owners(texts, stream):
    window, automaton = 3, substring_dedup.SuffixAutomaton()
    for k, t in enumerate(texts):
        automaton.add(t, k)
    automaton.close()
    got = automaton.owners(stream, window)
    for end in range(len(stream)):
        part = stream[end - window + 1 : end + 1] if end >= window - 1 else None
        owners = [k for k, t in enumerate(texts) if part and any(t[a : a + window] == part for a in range(len(t)))]
        assert got[end] == (min(owners) if owners else None)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "short"), (1, "short")]])
def test_small_tables(spark, rows):
    assert rows_of(substring_dedup.remove_repeats(documents(spark, rows)), *COLUMNS) == brute(rows)
