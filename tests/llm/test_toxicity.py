"""Toxicity: segments against brute force, held-out accuracy, odd tables."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import toxicity
from brindle.llm.common import table
from tests.llm.helpers import AWKWARD, documents, residue

SF = "/root/testdata/sf0.01"


def recursive_segments(scores, low=0, high=None):
    """The definition: the best segment, then the same to its left and right."""
    high = len(scores) if high is None else high
    best, at = 0, None
    for a in range(low, high):
        total = 0
        for b in range(a, high):
            total += scores[b]
            if total > best or (total == best and at and (a, -(b - a)) < (at[0], -(at[1] - 1 - at[0]))):
                best, at = total, (a, b + 1)
    if at is None:
        return []
    return [*recursive_segments(scores, low, at[0]), (*at, best), *recursive_segments(scores, at[1], high)]


@given(st.lists(st.integers(-7, 7).map(lambda x: x * 1009 + 1), max_size=14))
@settings(max_examples=300, deadline=None)
def test_segments_equal_the_recursive_definition(scores):
    totals = [t for _, _, t in recursive_segments(scores)]
    got = toxicity.maximal_segments(np.array(scores, float))
    assert all(sum(scores[a:b]) == t > 0 for a, b, t in got)
    assert all(x[1] <= y[0] for x, y in zip(got, got[1:], strict=False))
    assert sorted(t for _, _, t in got) == sorted(totals)


def test_surprise_grows_with_the_score_and_falls_with_length():
    values = [toxicity.surprise(s, 100, 0.8, 0.1) for s in (1, 5, 20, 60)]
    assert values == sorted(values)
    assert toxicity.surprise(8, 50, 0.8, 0.1) > toxicity.surprise(8, 5000, 0.8, 0.1)
    assert toxicity.surprise(0, 10, 0.8, 0.1) == 0


def auc(pairs):
    good, bad = [s for s, t in pairs if t], [s for s, t in pairs if not t]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


@pytest.mark.skipif(not __import__("os").path.exists(SF), reason="no test tables here")
def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    got = toxicity.scored_query(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()
    assert len(got) == table(spark, SF, "documents").count()
    assert all(r.held_out == (residue(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    pairs = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert auc(pairs) > 0.8  # two of the six toxic ones here have no toxic word; 0.965 on the tables of sf0.1
    assert np.mean([(s >= 0.5) == bool(t) for s, t in pairs]) > 0.95


BAD = ["you vile scum", "vile scum go away", "such scum, so vile", "vile! scum!"] * 12
GOOD = ["a quiet day by the sea", "the sea is calm today", "we read by the window", "day after day we read"] * 12


@pytest.fixture
def light_prior(monkeypatch):
    """Evidence of dozens of rows, not thousands, is enough here."""
    monkeypatch.setattr(toxicity, "PRIOR", 0.02)
    monkeypatch.setattr(toxicity, "LEAST", 0.5)


def small_tables(spark):
    rows = [(i, t) for i, t in enumerate(BAD + GOOD)]
    labels = spark.createDataFrame([(i, 1, int(i < len(BAD))) for i, _ in rows] + [(1, 0, 0), (None, 1, 1), (2, 1, None), (3, 1, 7)], "doc_id long, quality int, toxic int")
    return rows, labels


def test_passages_and_awkward_rows(spark, light_prior):
    rows, labels = small_tables(spark)
    model = toxicity.fit(documents(spark, rows, clashing=True), labels)
    assert model.lexicon.keys() >= {"vile", "scum"}
    extra = [(700, "we read by the sea " * 6 + "vile scum, such vile scum " + "by the window " * 6), (701, "word " * 50_000)]
    got = {r.doc_id: r for r in toxicity.score(documents(spark, rows + AWKWARD[2:] + extra, clashing=True), model).collect()}
    assert got[0].predicted == 1 and got[len(BAD)].predicted == 0
    assert got[900].score == got[901].score == got[902].score < 0.5
    assert got[701].passages == []
    steep = toxicity.Model({"vile": 5.0, "scum": 5.0}, {"such": 1.0}, 1.0, 0.1, -4.0, 1.0)
    got = {r.doc_id: r for r in toxicity.score(documents(spark, extra), steep).collect()}
    best = max(got[700].passages, key=lambda p: p.log_odds)
    assert (best.start, best.end) == (30, 35) and got[700].predicted == 1


def test_labels_of_held_out_rows_are_not_learned(spark, light_prior):
    rows, labels = small_tables(spark)
    held = [i for i, _ in rows if residue(i, 5) == 0]
    flipped = labels.selectExpr("doc_id", f"CASE WHEN doc_id IN ({', '.join(map(str, held))}) THEN 1 - toxic ELSE toxic END AS toxic")
    docs = documents(spark, rows)
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, flipped)


def test_clean_documents(spark, light_prior):
    rows, labels = small_tables(spark)
    docs = documents(spark, rows + AWKWARD, clashing=True)
    kept = toxicity.clean_documents(docs, labels)
    assert kept.schema == docs.schema
    assert sorted((r.doc_id is not None, r.doc_id) for r in kept.collect()) == sorted((i is not None, i) for i, t in rows + AWKWARD if t not in BAD)


def test_without_evidence_nothing_is_toxic(spark):
    """Labels that no word tells apart give no lexicon, so no document goes."""
    rows = list(enumerate(GOOD * 2))
    labels = spark.createDataFrame([(i, int(i % 12 < 4)) for i, _ in rows], "doc_id long, toxic int")
    docs = documents(spark, rows)
    assert toxicity.fit(docs, labels).lexicon == {}
    assert toxicity.clean_documents(docs, labels).count() == len(rows)


def brute_fit(rows, labels):
    """The model worked out row by row."""
    known = {}
    for i, t in labels:
        if i is not None and t in (0, 1) and residue(i, 5) != 0:
            known[i] = max(known.get(i, 0), t)
    texts = [(t, known[i], residue(i, 5)) for i, t in rows if i in known]
    words = lambda t: [w.lower().strip(toxicity.EDGES) for w in (t or "").split()]  # noqa: E731 ASCII texts here
    counts = {}
    for t, toxic, part in texts:
        for w in set(words(t)) if part != 4 else ():
            counts.setdefault(w, [0, 0])[toxic] += 1
    clean_all, toxic_all = (sum(c[k] for c in counts.values()) for k in (0, 1))
    pseudo = toxicity.PRIOR * (clean_all + toxic_all)

    def odds(clean, toxic):
        prior = pseudo * (clean + toxic) / (clean_all + toxic_all)
        a, b = toxic + prior, clean + prior
        score = math.log(a / (toxic_all + pseudo - a)) - math.log(b / (clean_all + pseudo - b))
        return score, score / math.sqrt(1 / a + 1 / b), b / (clean_all + pseudo)

    def significant(table):
        return {w: odds(*c) for w, c in table.items() if w and c[1] and odds(*c)[1] > toxicity.Z and odds(*c)[0] > toxicity.LEAST}

    def by_stem(table):
        out = {}
        for w, c in table.items():
            if len(w) > 4:
                own = out.setdefault(w[:4], [0, 0])
                own[0], own[1] = own[0] + c[0], own[1] + c[1]
        return out

    lexicon, stems = significant(counts), significant(by_stem(counts))
    rest = by_stem({w: c for w, c in counts.items() if w not in lexicon})
    gains = [(s, p) for s, _, p in lexicon.values()] + [(stems[w][0], odds(*rest[w])[2]) for w in stems if w in rest]
    hit = min(sum(p for _, p in gains), 0.5)
    low, high = 1e-3, 64.0
    for _ in range(200):
        lam = (low + high) / 2
        excess = sum(p * math.exp(lam * s) for s, p in gains) + (1 - hit) * math.exp(-lam * toxicity.DRIFT) - 1
        low, high = (lam, high) if excess < 0 else (low, lam)

    def best(text):
        values = [lexicon[w][0] if w in lexicon else stems[w[:4]][0] if len(w) > 4 and w[:4] in stems else -toxicity.DRIFT for w in words(text)]
        return max((sum(values[a:b]) for a in range(len(values)) for b in range(a + 1, len(values) + 1)), default=0.0), len(values)

    clean = [best(t) for t, toxic, part in texts if part == 4 and not toxic]
    k = len(clean) / sum(n * math.exp(-lam * max(s, 0)) for s, n in clean)
    return {w: s for w, (s, _, _) in lexicon.items()}, {w: s for w, (s, _, _) in stems.items()}, lam, k


def test_model_equals_brute_force(spark, light_prior):
    """Lexicon, stems and both numbers of the extreme-value law, among words that toxic and clean texts share."""
    rng = random.Random(9)
    rows = []
    for i in range(300):
        toxic = i % 3 == 0
        words = [rng.choice(["sea", "day", "window", "read", "calm", "quiet", "rather", "person"]) for _ in range(rng.randrange(3, 12))]
        words += rng.sample(["vile", "scum", "hateful", "hated", "hater", "rather"], 2) if toxic or rng.random() < 0.03 else []
        rng.shuffle(words)
        rows.append((i, " ".join(words).capitalize() + "!"))
    labels = [(i, int(i % 3 == 0)) for i, _ in rows]
    model = toxicity.fit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    lexicon, stems, lam, k = brute_fit(rows, labels)
    assert len(lexicon) > 2 and len(stems) > 0
    assert model.lexicon == pytest.approx(lexicon) and model.stems == pytest.approx(stems)
    assert (model.lam, model.k) == (pytest.approx(lam), pytest.approx(k))


def test_every_planted_passage_is_found(spark):
    """Passages of 2, 2 and 6 toxic words, three hundred words apart."""
    model = toxicity.Model({"vile": 5.0, "scum": 5.0, "filth": 5.0}, {}, 1.0, 0.1, -4.0, 1.0)
    calm = "sea " * 300
    text = calm + "vile scum " + calm + "vile scum " + calm + "vile scum filth vile scum filth " + calm
    (row,) = toxicity.score(documents(spark, [(1, text)]), model).collect()
    assert [(p.start, p.end) for p in row.passages] == [(300, 302), (602, 604), (904, 910)]
    assert row.passages[2].log_odds == pytest.approx(30.0)


def test_repeated_rows_and_rows_without_an_id(spark):
    model = toxicity.Model({"vile": 9.0}, {}, 1.0, 0.1, -4.0, 1.0)
    rows = [(1, "vile"), (1, "vile"), (None, "vile"), (None, None)]
    got = toxicity.score(documents(spark, rows), model).collect()
    assert [(r.doc_id, r.predicted) for r in got if r.doc_id] == [(1, 1)] * 2
    assert sorted(r.predicted for r in got if r.doc_id is None) == [0, 1]


@pytest.mark.parametrize("kept", ["toxic = 1", "toxic = 0", "false"])
def test_one_class_or_no_labels(spark, kept):
    rows, labels = small_tables(spark)
    got = toxicity.scored_query(documents(spark, rows), labels.filter(kept)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)


def test_empty_table(spark):
    assert toxicity.scored_query(documents(spark, []), small_tables(spark)[1]).collect() == []


@pytest.mark.parametrize("times", [1, 2, 9])
def test_every_mention_counts(spark, times):
    model = toxicity.Model({"vile": 5.0, "scum": 4.0}, {}, 1.0, 0.1, -4.0, 1.0)
    (row,) = toxicity.score(documents(spark, [(1, "sea " * 40 + "vile scum " * times + "sea " * 40)]), model).collect()
    assert [(p.start, p.end, p.log_odds) for p in row.passages] == [(40, 40 + 2 * times, pytest.approx(9.0 * times))]


def test_earlier_mentions_erase_no_passage():
    """A dense passage counts the same wherever its words occurred before."""
    model = toxicity.Model({"vile": 5.0, "scum": 5.0}, {}, 1.0, 0.1, -4.0, 1.0)
    one = toxicity._scorer(model)
    alone, before = "sea " * 1600 + "vile scum vile scum", ("sea " * 399 + "vile ") * 2 + ("sea " * 399 + "scum ") * 2
    n, found = one(before + "sea " * 400 + "vile scum vile scum")
    assert max(found, key=lambda f: f[2]) == (n - 4, n, pytest.approx(20.0))
    assert max(f[2] for f in one("sea " * (n - 4) + "vile scum vile scum")[1]) == pytest.approx(20.0)
    assert toxicity.surprise(max(f[2] for f in one(alone)[1]), 1604, model.lam, model.k) > 4
    far = one("vile scum vile scum " + "sea " * 1000 + "vile scum vile scum")[1]
    assert [f[:2] for f in far] == [(0, 4), (1004, 1008)] and far[0][2] == pytest.approx(far[1][2])


def test_the_bound_leaves_the_class_rate(spark, light_prior):
    """One population, below the bound and with its clean rows cut by it: scores stay."""
    toxic = ["you vile scum"] * 70 + ["hello there"] * 30
    clean = ["the sea is calm today", "hello there", "a quiet day by the sea", "we read by the window"] * 390 + ["vile weather, scum on the sea"] * 40
    rows = list(enumerate(toxic + clean))
    labels = spark.createDataFrame([(i, int(i < len(toxic))) for i, _ in rows], "doc_id long, toxic int")
    docs = documents(spark, rows)
    whole, cut = (toxicity.fit(docs, labels, fit_rows=n) for n in (10_000, 110))

    def log_odds(model):
        every = [toxicity._scorer(model)(t) for t in ("hello there", "vile scum")]
        return np.array([toxicity.logit(model, max((f[2] for f in found), default=0.0), n) for n, found in every])

    assert np.abs(log_odds(whole) - log_odds(cut)).max() < 0.8  # ln 16 = 2.8 without weights
