"""Similar documents against comparing every pair."""

import random

import pytest

from brindle.llm import ngram_join
from brindle.llm.components import components
from tests.llm.helpers import AWKWARD, documents, rows_of, sentence, words

COLUMNS = ("doc_id", "n_shingles", "component_id")


def shingles(text):
    w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in words(text)]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t))
    flat = [(i, s) for i, many in sets.items() for s in many]
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, (i, s) in enumerate(flat):
        for j, t in flat[:x]:
            both = len(s & t)
            if both and 100 * both >= 80 * (len(s) + len(t) - both):
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    return sorted((i, len(s), find(i)) for i, s in flat)


def near_copies(seed=1, groups=12):
    """Groups of texts with changed words, so that similarities fall on both sides of the threshold."""
    rng, rows, at = random.Random(seed), [], 0
    for g in range(groups):
        base = sentence(rng, rng.choice((5, 6, 9, 30, 80, 300))).split()
        for _ in range(rng.choice((1, 2, 5, 12))):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9)}"
            if rng.random() < 0.4:
                own += sentence(rng, rng.randrange(1, 9)).split()
            rows.append((at, " ".join(own).upper() if rng.random() < 0.2 else "  ".join(own)))
            at += 1
    rng.shuffle(rows)
    return rows


def test_equals_brute_force(spark):
    rows = near_copies() + [r for r in AWKWARD if r[0] is not None] + [(905, "ONE"), (906, "one two three"), (907, "One two  three"), (904, "one")]
    assert rows_of(ngram_join.similar_documents(documents(spark, rows, clashing=True)), *COLUMNS) == brute(rows)


def test_joined_by_a_shuffle(spark, monkeypatch):
    """More possible partners than are broadcast, and repeated rows."""
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 3)
    rows = near_copies(3)
    rows += rows[:5] * 2
    assert rows_of(ngram_join.similar_documents(documents(spark, rows)), *COLUMNS) == brute(rows)


def test_one_id_with_different_texts(spark):
    """Both texts' links count, and join their components."""
    a, b = sentence(random.Random(8), 40), sentence(random.Random(9), 40)
    rows = [(5, a), (5, b), (7, a + " more"), (6, b + " end"), (8, "other text of some words here")]
    assert rows_of(ngram_join.similar_documents(documents(spark, rows)), *COLUMNS) == brute(rows)
    kept = ngram_join.distinct_documents(documents(spark, rows)).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(5, max(a, b, key=lambda t: (len(t), [-ord(c) for c in t]))), (8, rows[-1][1])])


def test_long_texts(spark):
    """Near copies of a text of many slices."""
    rng = random.Random(10)
    base = sentence(rng, 60_000).split()
    other = list(base)
    for k in range(0, 60_000, 60):
        other[k] = "changed"
    rows = [(1, " ".join(base)), (2, " ".join(other)), (3, sentence(rng, 60_000))]
    assert rows_of(ngram_join.similar_documents(documents(spark, rows)), *COLUMNS) == brute(rows)


def test_crowded_tokens(spark, monkeypatch):
    """Everything shares tokens, so that pivots and the last, full round are used."""
    monkeypatch.setattr(ngram_join, "BUCKET", 2)
    monkeypatch.setattr(ngram_join, "PIVOTS", (1,))
    rng, base = random.Random(4), sentence(random.Random(3), 60).split()
    rows = []
    for i in range(60):
        own = list(base)
        for _ in range(rng.randrange(5)):
            own[rng.randrange(60)] = f"y{rng.randrange(50)}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join(base[:20] + sentence(rng, 40 + i).split())) for i in range(20)]
    assert rows_of(ngram_join.similar_documents(documents(spark, rows)), *COLUMNS) == brute(rows)


def test_exact_threshold(spark):
    """Sets of 9 and 9 sharing 8: 80 percent; of 10 and 9 sharing 8: below."""
    a = [f"a{i}" for i in range(13)]
    rows = [(1, " ".join(a)), (2, " ".join(a[1:] + ["z"])), (3, " ".join(a[1:] + ["z", "q"]))]
    assert rows_of(ngram_join.similar_documents(documents(spark, rows)), *COLUMNS) == brute(rows)


def test_rows_without_an_id(spark):
    got = ngram_join.similar_documents(documents(spark, [(None, "a b c d e f"), (1, "a b c d e f")])).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id) for r in got if r.doc_id) == [(1, 2, 1)]
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(2, None)]


def test_distinct_documents(spark):
    rows = near_copies(7) + [(901, ""), (902, None), (None, "no id"), (0, "again")]
    docs = documents(spark, rows, clashing=True)
    kept = ngram_join.distinct_documents(docs)
    assert kept.columns == docs.columns
    want = {i for i, _, c in brute([r for r in rows if r[0] is not None]) if i == c} | {None}
    assert {r.doc_id for r in kept.collect()} == want


@pytest.mark.parametrize(
    ("at_once", "links"),
    [(100_000, []), (100_000, [(1, 1)]), (100_000, [(0, i) for i in range(1, 30)] + [(50, 51)]), (3, [(i, i + 1) for i in range(40)] + [(50, 51)]), (3, [(i * 37 % 59, (i * 37 + 37) % 59) for i in range(45)])],
)
def test_components(spark, monkeypatch, links, at_once):
    monkeypatch.setattr("brindle.llm.components.TASK_LINKS", at_once)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(8)).collect()}
    want = {i: min(j for j in range(60) if j in parts) for parts in _parts(links) for i in parts}
    assert got == want


def _parts(links):
    parts = []
    for a, b in links:
        if a != b:
            hit = [p for p in parts if a in p or b in p]
            parts = [p for p in parts if p not in hit] + [set().union({a, b}, *hit)]
    return parts


def test_empty_table(spark):
    assert ngram_join.similar_documents(documents(spark, [])).collect() == []
