"""Connected components of a table of links, by contraction in tasks and alternating stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm.common import lean, materialise

#: Links that one task contracts at once, about.
TASK_LINKS = 100_000


def contracted(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links from each vertex to the smallest one that these links connect it with, itself left out."""
    names, codes = np.unique(np.concatenate([u, v]), return_inverse=True)
    up = list(range(len(names)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in zip(codes[: len(u)].tolist(), codes[len(u) :].tolist(), strict=True):
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    roots = np.fromiter(map(root, range(len(names))), np.int64, len(names))
    far = roots != np.arange(len(names))
    return names[far], names[roots[far]]


def _in_tasks(links: DataFrame, tasks: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if parts:
            u, v = contracted(*(np.concatenate(c) for c in zip(*parts, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return links.coalesce(tasks).mapInArrow(lean(run), "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every id in links (a, b).

    Each task first contracts the links that it holds to stars. Where that takes
    several tasks, rounds follow that point every id at the smallest id around
    it: first its larger neighbours to the smallest of all its neighbours, then
    its smaller ones. The number of rounds grows with the logarithm of the
    longest chain of stars. A hub costs no more than its links; rounds are
    written out, so that a lost executor repeats one round at most. Links of an
    id with itself say nothing. An empty table gives no rows.
    """
    links = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v"), "links")
    tasks = 1 + links.count() // TASK_LINKS
    edges = materialise(_in_tasks(links, tasks).distinct(), "stars")
    while tasks > 1:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        large = materialise(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        edges = materialise(small, "small-star")
        # done when all that is left are stars: no id has two centres, and no centre has one
        several = edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").select("u")
        chained = edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").select("u")
        if not several.unionByName(chained).limit(1).count():
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
