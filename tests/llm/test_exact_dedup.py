"""Exact deduplication against grouping in plain Python."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm.exact_dedup import QuotientFilter, drop_copies, exact_dedup
from tests.llm.helpers import AWKWARD, documents, rows_of

prints = st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 50), max_size=60)
COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def counted(values):
    return {v: values.count(v) for v in values}


@given(prints, prints)
@settings(max_examples=60, deadline=None)
def test_filters_merge_without_loss(a, b):
    made = [QuotientFilter.build(np.array(x, np.uint64), r=60) for x in (a, b)]
    merged = QuotientFilter.from_bytes(made[0].merge(made[1]).to_bytes())
    assert dict(zip(merged.fingerprints().tolist(), merged.counts.tolist(), strict=True)) == counted(a + b)
    assert list(merged.fingerprints()) == sorted(set(a + b))


def brute(rows):
    norm = lambda t: (t or "").translate(dict.fromkeys([32, 9, 10, 11, 12, 13]))
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((i, len(t or "")))
    out, seen = [], set()
    for i, t in rows:
        group = groups[norm(t)]
        named = [g for g in group if g[0] is not None]
        most = max(n for _, n in group)
        best = min((g[0] for g in named if g[1] == most), default=None) if any(g[1] == most for g in named) else None
        sha = hashlib.sha256(norm(t).encode()).hexdigest()
        out.append((i, best, len(group), i == best and (i, sha) not in seen, sha))
        if i == best:
            seen.add((i, sha))
    return sorted(out, key=lambda r: [(v is not None, v) for v in r])


def test_groups_equal_brute_force(spark):
    rows = [r for r in AWKWARD if r[0] is not None] + [(1, "a b"), (2, "ab"), (3, "a  b"), (4, "ab "), (5, "other"), (5, "other"), (6, " "), (7, "a b" * 20_000), (8, "a b" * 20_000 + "\n")]
    assert rows_of(exact_dedup(documents(spark, rows, clashing=True)), *COLUMNS) == brute(rows)


def test_row_without_an_id(spark):
    got = exact_dedup(documents(spark, [(None, "x"), (3, " x"), (None, "alone")])).collect()
    assert sorted((r.doc_id is None, r.keep_id, r.group_size, r.kept) for r in got if r.group_size == 2) == [(False, 3, 2, True), (True, 3, 2, False)]
    assert [(r.doc_id, r.keep_id, r.kept) for r in got if r.group_size == 1] == [(None, None, True)]


def test_large_group_of_copies(spark):
    rows = [(i, "copy " * (1 + i % 2)) if i % 3 else (i, f"own {i}") for i in range(600)]
    assert rows_of(exact_dedup(documents(spark, rows)), *COLUMNS) == brute(rows)


def test_drop_copies_keeps_columns(spark):
    docs = documents(spark, [(1, "a b"), (2, "ab"), (2, "ab"), (3, "c"), (4, None), (5, "")], clashing=True)
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


@pytest.mark.parametrize("make", [exact_dedup, drop_copies])
def test_empty_table(spark, make):
    assert make(documents(spark, [])).collect() == []
