"""Strongly connected components of edge lists, and the cycles they are."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions.vocab import DETECTION
from brindle.operators.numbering import number_rows
from brindle.session import written


#: Edges that one task takes at once.
TASK_EDGES = 200_000
#: Searches that the small parts of a large graph are dealt to, at least.
BINS = 64


def strong_components(edges: DataFrame) -> DataFrame:
    """graph, v, component (the smallest member) of all vertices of edges (graph, a, b).

    Graphs of up to TASK_EDGES edges are searched whole, one a task. Larger ones
    lose edges that are in no cycle and are cut into weakly connected parts, of which as many
    are searched by a task as fit. Parts beyond that stay spread out over tasks and are coloured, so
    a graph may be far larger than one task. Edges without a start or end are
    left out; repeated ones count once; an empty table gives no rows.
    Joins of vertices are told to shuffle, as files of them are far smaller than the vertices.
    """
    edges = written(edges.select("graph", "a", "b").filter("a IS NOT NULL AND b IS NOT NULL").distinct(), "scc-edges")
    found, large = _searched(edges.withColumn("part", F.lit(0).cast("long")))
    if large is None:
        return found
    large = large.drop("part")
    # what no cycle can go through may be all that holds the rest together
    left = _trimmed(large)
    more, rest = _searched(_in_parts(left), BINS + 2 * left.count() // max(1, TASK_EDGES))
    more = written(more if rest is None else more.unionByName(_coloured(rest.drop("part"))), "scc-found")
    ends = large.select("graph", F.explode(F.array("a", "b")).alias("v")).distinct()
    singles = ends.join(more.select("graph", "v").hint("merge"), ["graph", "v"], "left_anti").withColumn("component", F.col("v"))
    return found.unionByName(more).unionByName(singles)


def _searched(edges: DataFrame, bins: int = 1) -> tuple[DataFrame, DataFrame | None]:
    """The components of the parts (graph, part) that fit a task, and the edges of all others, if any. Parts of a graph are dealt to `bins` searches."""
    schema = f"{_columns(edges)}, component {_kind(edges)}"
    search = lambda df: df.withColumn("bin", F.pmod("part", F.lit(bins))).groupBy("graph", "bin").applyInPandas(_search, schema)
    sizes = edges.groupBy("graph", "part").agg(F.count("*").alias("n"))
    many = sizes.filter(F.col("n") > TASK_EDGES).select("graph", "part")
    if not many.limit(1).count():
        return search(edges), None
    return search(edges.join(many, ["graph", "part"], "left_anti")), written(edges.join(many, ["graph", "part"], "left_semi"), "scc-large")


def _kind(edges: DataFrame) -> str:
    return edges.schema["a"].dataType.simpleString()


def _columns(edges: DataFrame) -> str:
    return f"graph {edges.schema['graph'].dataType.simpleString()}, v {_kind(edges)}"


def _search(edges: pd.DataFrame) -> pd.DataFrame:
    """The strong components of one graph in two depth-first passes: vertices by when their search ends, then back along edges."""
    codes, names = pd.factorize(pd.concat([edges["a"], edges["b"]], ignore_index=True), sort=True)
    n, m = len(names), len(edges)
    forward, backward = [[] for _ in range(n)], [[] for _ in range(n)]
    for a, b in zip(codes[:m].tolist(), codes[m:].tolist(), strict=True):
        forward[a].append(b)
        backward[b].append(a)
    ended, seen = [], [False] * n
    for root in range(n):
        if seen[root]:
            continue
        seen[root], stack = True, [(root, iter(forward[root]))]
        while stack:
            v, following = stack[-1]
            w = next((w for w in following if not seen[w]), None)
            if w is None:
                ended.append(v)
                stack.pop()
            else:
                seen[w] = True
                stack.append((w, iter(forward[w])))
    least = [-1] * n
    for root in reversed(ended):
        if least[root] >= 0:
            continue
        least[root], members = n, [root]
        for v in members:
            for w in backward[v]:
                if least[w] < 0:
                    least[w] = n
                    members.append(w)
        first = min(members)
        for v in members:
            least[v] = first
    return pd.DataFrame({"graph": edges["graph"].iloc[0], "v": names, "component": names.take(least)})


def _in_parts(edges: DataFrame) -> DataFrame:
    """edges with `part`: a number for each weakly connected part.

    Vertices are hashes, which take new values in each round, and a vertex is merged into the least of itself and its
    neighbours. So as many as half of them are left or fewer, whatever the shape of the graph, until
    a task can take all that is between them. What two vertices of one hash join by mistake is searched together and comes out apart.
    """
    hashed = lambda c: F.xxhash64("graph", c)
    left, rounds = _between(edges.select(hashed("a").alias("a"), hashed("b").alias("b"))), []
    while left.count() > TASK_EDGES:
        anew = lambda c: F.xxhash64(F.lit(len(rounds)), c)  # noqa: E731, B023
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        merged = written(both.groupBy(F.col("a").alias("v")).agg(F.min(anew("b")).alias("least")).select("v", F.least("least", anew("v")).alias("into")), "scc-merged")
        into = lambda c: merged.select(F.col("v").alias(c), F.col("into").alias(f"_{c}")).hint("merge")  # noqa: E731, B023
        left = _between(left.join(into("a"), "a").join(into("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
        rounds.append(merged)
    parts = left.groupBy().applyInPandas(_connected, "v long, part long")
    for merged in reversed(rounds):
        parts = merged.join(parts.withColumnRenamed("v", "into").hint("merge"), "into", "left").select("v", F.coalesce("part", "into").alias("part"))
    parts = written(parts, "scc-parts")
    own = edges.withColumn("v", hashed("a")).join(parts.hint("merge"), "v", "left")
    return own.select("graph", "a", "b", F.coalesce("part", "v").alias("part"))


def _between(edges: DataFrame) -> DataFrame:
    """The different pairs of vertices that edges join."""
    return written(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "scc-between")


def _connected(edges: pd.DataFrame) -> pd.DataFrame:
    """The least vertex of each weakly connected part of one graph."""
    codes, names = pd.factorize(pd.concat([edges["a"], edges["b"]], ignore_index=True), sort=True)
    least, m = list(range(len(names))), len(edges)

    def root(v: int) -> int:
        while least[v] != v:
            least[v] = v = least[least[v]]
        return v

    for a, b in zip(codes[:m].tolist(), codes[m:].tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            least[max(a, b)] = min(a, b)
    return pd.DataFrame({"v": names, "part": names.take([root(v) for v in range(len(names))])})


def _coloured(edges: DataFrame) -> DataFrame:
    """The same by rounds of colouring: every vertex takes the largest name that
    reaches it, and a vertex whose name returns to it along edges within its
    colour is in that colour's component. Finished components leave the graph.
    """
    spark: SparkSession = edges.sparkSession
    left = written(edges.select("graph", "a", "b").distinct(), "scc-edges")
    done = left.select("graph", F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("component", F.col("v"))
    found = spark.createDataFrame([], done.schema)
    while left.limit(1).count():
        left = _trimmed(left)
        colours = left.select("graph", F.explode(F.array("a", "b")).alias("v")).distinct().withColumn("colour", F.col("v"))
        colours = _spread(colours, left, "a", "b")
        tagged = left.join(colours.select("graph", F.col("v").alias("a"), F.col("colour").alias("ca")).hint("merge"), ["graph", "a"]).join(colours.select("graph", F.col("v").alias("b"), F.col("colour").alias("cb")).hint("merge"), ["graph", "b"])
        inside = written(tagged.filter("ca = cb").select("graph", "a", "b", F.col("ca").alias("colour")), "scc-inside")
        reached = _backwards(colours, inside)
        found = found.unionByName(written(reached.select("graph", "v", F.min("v").over(Window.partitionBy("graph", "colour")).alias("component")), "scc-found"))
        gone = reached.select("graph", "v")
        left = written(left.join(gone.withColumnRenamed("v", "a").hint("merge"), ["graph", "a"], "left_anti").join(gone.withColumnRenamed("v", "b").hint("merge"), ["graph", "b"], "left_anti").select("graph", "a", "b"), "scc-edges")
    singles = done.join(found.select("graph", "v").hint("merge"), ["graph", "v"], "left_anti")
    return found.unionByName(singles)


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges without those that begin where none ends or end where none begins, as long as that takes a tenth of them off."""
    before = edges.count()
    while before:
        starts, ends = edges.select("graph", F.col("a").alias("v")).distinct(), edges.select("graph", F.col("b").alias("v")).distinct()
        inner = edges.join(ends.withColumnRenamed("v", "a").hint("merge"), ["graph", "a"], "left_semi").join(starts.withColumnRenamed("v", "b").hint("merge"), ["graph", "b"], "left_semi")
        edges = written(inner.select("graph", "a", "b"), "scc-trimmed")
        after = edges.count()
        if 10 * (before - after) < before:
            break
        before = after
    return edges


def _spread(colours: DataFrame, edges: DataFrame, start: str, end: str) -> DataFrame:
    """Colours carried along edges until each vertex has the largest that reaches it."""
    while True:
        carried = edges.join(colours.withColumnRenamed("v", start).hint("merge"), ["graph", start]).select("graph", F.col(end).alias("v"), "colour")
        after = written(colours.unionByName(carried).groupBy("graph", "v").agg(F.max("colour").alias("colour")), "scc-colours")
        if not after.join(colours.hint("merge"), ["graph", "v", "colour"], "left_anti").limit(1).count():
            return after
        colours = after


def _backwards(colours: DataFrame, inside: DataFrame) -> DataFrame:
    """The vertices that reach the one their colour is named after, within the colour."""
    reached = written(colours.filter("v = colour"), "scc-reached")
    while True:
        more = inside.join(reached.withColumnRenamed("v", "b").hint("merge"), ["graph", "b", "colour"]).select("graph", F.col("a").alias("v"), "colour").distinct()
        new = more.join(reached.hint("merge"), ["graph", "v"], "left_anti")
        after = written(reached.unionByName(new.select(*reached.columns)), "scc-reached")
        if after.count() == reached.count():
            return after
        reached = after


def cycles(edges: DataFrame) -> DataFrame:
    """graph, n, members, size of every component with two members or a self-loop, numbered by members."""
    edges = written(edges.select("graph", "a", "b"), "cycle-edges")
    loops = edges.filter("a = b").select("graph", F.col("a").alias("component"), F.lit(True).alias("loop")).distinct()
    groups = strong_components(edges).groupBy("graph", "component").agg(F.array_sort(F.collect_set("v")).alias("members"))
    real = groups.join(loops.hint("merge"), ["graph", "component"], "left").filter((F.size("members") > 1) | F.col("loop"))
    # components share no member, so their first ones, which name them, have the order of the lists
    return number_rows(real, [F.col("component")], by=("graph",)).select("graph", F.col("n").cast("int").alias("n"), "members", F.size("members").alias("size"))


def cycle_smells(edges: DataFrame, tool: str = "static_graph") -> DataFrame:
    """Cycles as smell records, `graph` being the source file."""
    found = cycles(edges)
    return found.select(F.lit(tool).alias("tool"), F.concat(F.lit("scc"), F.col("n").cast("string")).alias("tool_record_id"), F.col("graph").alias("source_file"), F.col("n").cast("long").alias("row_no"), F.lit("Cyclic Dependency").alias("smell_type_raw"), F.col("members").alias("affected_components"), F.create_map(F.lit("cycle_size"), F.col("size").cast("string"), F.lit("detection"), F.lit(DETECTION)).alias("attributes"))
