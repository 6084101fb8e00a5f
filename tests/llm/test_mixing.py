"""Mixing: budgets by hand, streams against plain Python."""

import hashlib
import random

import pytest

from brindle.llm import mixing
from tests.llm.helpers import AWKWARD, documents, words


def level(children, budget):
    """{name: (weight, capacity)} filled from `budget`, shortages shared among the rest."""
    share, left = {}, dict(children)
    budget = min(budget, sum(c for _, c in children.values()))
    while left:
        total = sum(w for w, _ in left.values())
        full = {k for k, (w, c) in left.items() if c <= w / total * budget + 1e-9}
        if not full:
            return share | {k: w / total * budget for k, (w, _) in left.items()}
        for k in full:
            share[k] = float(left[k][1])
            budget -= left[k][1]
            del left[k]
    return share


def leaf_of(row):
    lang, source = row[2] or "", row[3] or ""
    digits = source[len(source.rstrip("0123456789")) :][-9:]
    return f"d{int(digits or 0) % 4}", lang, source


def brute_budgets(rows, ratio, epochs, alpha, weights):
    tokens = {}
    for r in rows:
        tokens[leaf_of(r)] = tokens.get(leaf_of(r), 0) + len(words(r[1]))
    tokens = {k: v for k, v in tokens.items() if v}

    def down(path, budget):
        if len(path) == 3:
            return {path: int(budget + 1e-6)}
        names = {k[: len(path) + 1] for k in tokens if k[: len(path)] == path}
        own = {n: sum(v for k, v in tokens.items() if k[: len(n)] == n) for n in names}
        shares = level({n: (weights.get(n, own[n] ** alpha), own[n] * epochs) for n in names}, budget)
        return {k: v for n in names for k, v in down(n, shares[n]).items()}

    return tokens, down((), min(int(sum(tokens.values()) * ratio), sum(tokens.values()) * epochs))


def brute(rows, ratio=1.0, epochs=4, alpha=0.7, weights=None, seed=17):
    tokens, budgets = brute_budgets(rows, ratio, epochs, alpha, weights or {})
    out = []
    for leaf, budget in budgets.items():
        own = [(r[0], r[1] or "") for r in rows if leaf_of(r) == leaf]
        full, rest = divmod(budget, tokens[leaf])
        for e in range(full):
            out += [(i, *leaf, e, len(words(t)), len(words(t))) for i, t in own]
        md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
        key = lambda d: (int(md5(f"{seed}|{full}|{'' if d[0] is None else d[0]}|{md5(d[1])}")[:15], 16), md5(d[1]))
        for i, t in sorted(own, key=key):
            used = min(rest, len(words(t)))
            rest -= used
            if used:
                out.append((i, *leaf, full, len(words(t)), used))
    return sorted(out, key=str)


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        source = rng.choice(["src0"] * 8 + ["src1", "src2", "src5", "web", None])
        rows.append((i, "word " * rng.choice((0, 1, 5, 30, 200)), rng.choice(["en", "en", "de", None]), source))
    return rows


def mixed(spark, rows, clashing=False, **options):
    got = mixing.mix(documents(spark, rows, clashing), **options).collect()
    return sorted(((r.doc_id, r.domain, r.lang, r.source, r.epoch, r.doc_tokens, r.used_tokens) for r in got), key=str)


@pytest.mark.parametrize("options", [{}, {"ratio": 0.3}, {"ratio": 3.0, "epochs": 2, "alpha": 0.0}, {"ratio": 9.0}, {"weights": {("d0",): 5.0, ("d1", "en"): 900.0, ("d0", "en", "src0"): 0.5}}])
def test_equals_brute_force(spark, options):
    rows = corpus() + [(i, t, "en", "src1") for i, t in AWKWARD]
    names = {"ratio": "budget_ratio", "epochs": "max_epochs"}
    assert mixed(spark, rows, clashing=True, **{names.get(k, k): v for k, v in options.items()}) == brute(rows, **options)


def test_buckets_of_a_leaf(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 5)
    rows = corpus(3)
    assert mixed(spark, rows) == brute(rows)


def test_repeated_rows_are_used_as_often(spark):
    rows = [(1, "a b", "en", "src0")] * 5 + [(2, "c", "en", "src0")]
    got = mixed(spark, rows)
    assert sum(r[-1] for r in got) == 11


def test_texts_are_cut_after_whole_words(spark):
    docs = documents(spark, corpus(5), clashing=True)
    out = mixing.mixed_documents(docs, budget_ratio=0.4)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    got = out.collect()
    assert sum(len(words(r.text)) for r in got) == sum(r[-1] for r in mixed(spark, corpus(5), budget_ratio=0.4))
    assert all(r.n_chars == len(r.text) for r in got)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_first_words(spark, n):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([("\t a  b x\n c",), ("a",), (" \n",)], "t string").select(mixing.first_words(F.col("t"), F.lit(n))).collect()
    assert [words(r[0]) for r in got] == [words("\t a  b x\n c")[:n], ["a"], []]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None)], [(1, "", "en", "src0"), (2, " ", "de", "src1")]])
def test_no_tokens(spark, rows):
    assert mixed(spark, rows) == []
