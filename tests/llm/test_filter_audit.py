"""The audit of filters against applying them one after the other."""

import random
import re
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.llm import filter_audit
from tests.llm.helpers import AWKWARD, documents, rows_of, words

COLUMNS = ("part", "filter_order", "step", *filter_audit.COUNTS)


def fails(rows, row):
    i, text = row[0], row[1] or ""
    w = words(text)
    return (
        ("A" if len(w) < 100 else "")
        + ("B" if 100 * len(set(w)) < 80 * len(w) else "")
        + ("C" if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text) else "")
        + ("D" if re.search(r"[#$%&*|]", text) else "")
        + ("E" if i is not None and any(r[0] is not None and r[0] < i and (r[1] or "") == text for r in rows) else "")
    )


def brute(rows, labels):
    good, toxic = ({r[0] for r in labels if r[k] == 1 and r[0] is not None} for k in (1, 2))
    out = []
    for part in {r[2] or "" for r in rows}:
        docs = [(r[0], fails(rows, r)) for r in rows if (r[2] or "") == part]
        total = dict.fromkeys("ABCDE", 0)
        steps = []
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone, here = [d for d in docs if d not in left], [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                total[f] += len(here)
                steps.append((part, order, step, len(left), len(here), sum(f in m for _, m in gone), sum(m == f for _, m in docs), sum(i in good for i, _ in here), sum(i in toxic for i, _ in here), f))
        out += [(*s[:-1], total[s[-1]]) for s in steps]
    return sorted(out)


def test_equals_applying_the_filters(spark):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice(["ab", "Cd", "EFG", "é", "#", "x", "yy", f"w{rng.randrange(400)}", f"v{rng.randrange(400)}"][rng.randrange(6) :]) for _ in range(rng.choice([3, 99, 100, 101, 140])))
    base = [(i, text(), rng.choice(["en", "de"]), "s") for i in range(60)]
    copies = [(200 + k, base[k % 7][1], "de", "s") for k in range(30)]
    rows = [*base, *copies, (7, base[7][1], "en", "s"), *[(i, t, None, "s") for i, t in AWKWARD], (None, "a row without an id", "", "s"), (905, "x" * 900, "", "s"), (906, "", "en", "s")]
    # a row is told apart by its number in brute(), so rows repeated whole are left to the next test
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 230, 3)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1), (6, None, None)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = list(dict.fromkeys(rows))
    rows = [r for k, r in enumerate(rows) if r[0] not in (None, 7) or k == [x[0] for x in rows].index(r[0])]
    assert rows_of(filter_audit.audit(documents(spark, rows, clashing=True).repartition(5), table), *COLUMNS) == brute(rows, table.collect())


def test_copies_repeated_rows_and_rows_without_an_id(spark):
    long = " ".join(f"w{i}" for i in range(120))
    rows = [(5, long), (5, long), (9, long), (9, long), (None, long), (None, long), (1, long + "x")]
    got = {r.filter_order + str(r.step): r for r in filter_audit.audit(documents(spark, rows), spark.createDataFrame([(9, 1, 1)], "doc_id long, quality int, toxic int")).collect()}
    assert got["EABCD1"].removed == 2 == got["EABCD1"].good_lost == got["EABCD1"].toxic_lost and got["EABCD5"].kept == 5
    assert got["ABCDE5"].shapley == 240 and got["ABCDE5"].unique_fails == 2


def test_empty_table(spark):
    assert filter_audit.audit(documents(spark, []).limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB #$é \x1c\t\n\x0b東🙂", max_size=40)), max_size=8))
def test_measures(texts):
    texts = [*texts, "z" * 300 + " " + "z" * 300 + " " + "z" * 299 + "y", "longer-than-eight longer-than-eighty longer-than-eight"]
    got = filter_audit.measures(pa.array(["skipped", *texts], pa.string()).slice(1))
    assert got["words"].tolist() == [len(words(t)) for t in texts]
    assert got["distinct"].tolist() == [len(set(words(t))) for t in texts]
    assert got["points"].tolist() == [len(t or "") for t in texts]
    assert got["capitals"].tolist() == [len(re.findall("[A-Z]", t or "")) for t in texts]
    assert got["symbols"].tolist() == [len(re.findall(r"[#$%&*|]", t or "")) for t in texts]


@pytest.mark.parametrize("hashes", [0, 1])
def test_words_with_one_hash_are_told_apart(hashes):
    data = np.frombuffer(b"ab cd ab cd ef gh", np.uint8)
    starts, lengths = np.array([0, 3, 6, 9, 12, 15]), np.full(6, 2)
    same = np.zeros(6, np.uint64) if hashes == 0 else np.array([1, 1, 1, 1, 2, 3], np.uint64) << np.uint64(20)
    assert filter_audit.distinct_words(data, starts, lengths, np.array([0, 0, 0, 0, 1, 1]), 3, same).tolist() == [2, 2, 0]
