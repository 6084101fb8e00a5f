"""Evidence cases from raw findings, edges and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import canonical_smell, content_id, numbered
from brindle.functions.vocab import NO_EDGES, OPEN_PAIRS, OPEN_PAIRS_END, PROVENANCE, TAXONOMY
from brindle.operators.numbering import number_rows

#: Pairs that a limitation names.
NAMED_PAIRS = 5
#: Components up to which all pairs of a case are looked at in its row.
SMALL_CASE = 24


def clean_attributes(attributes: Column) -> Column:
    """Attributes under snake-case names, without empty values and without what says where a record came from.

    Where two names become one, the later value stays.
    """
    entries = F.filter(F.map_entries(attributes), lambda e: e["value"].isNotNull() & (e["value"] != ""))
    named = F.transform(entries, lambda e: F.struct(F.replace(F.lower(F.trim(e["key"])), F.lit(" "), F.lit("_")).alias("key"), e["value"].alias("value")))
    used = F.filter(named, lambda e: ~e["key"].isin(*PROVENANCE))
    last = F.filter(used, lambda e, i: ~F.exists(F.slice(used, i + 2, F.size(used)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def group_findings(smells: DataFrame, taxonomy: tuple = TAXONOMY) -> DataFrame:
    """One row per project, smell key and set of components, with its findings in order of import.

    `smells` has project, seq (order of import), tool, tool_record_id,
    source_file, smell_type_raw, affected_components, attributes. Findings
    without components are left out.
    """
    named = smells.withColumns({"components": F.array_sort(F.array_distinct("affected_components")), "label": canonical_smell(F.col("smell_type_raw"), taxonomy)}).filter(F.size("components") > 0)
    finding = F.struct("seq", "tool", "tool_record_id", "source_file", clean_attributes(F.col("attributes")).alias("attributes"), F.col("label.smell_type").alias("smell_type"), F.col("label.code").alias("code"))
    groups = named.withColumn("smell_key", F.col("label.smell_key")).groupBy("project", "smell_key", "components").agg(F.array_agg(finding).alias("findings"))
    ordered = groups.withColumn("findings", F.array_sort("findings", lambda a, b: F.when(a["seq"] < b["seq"], -1).when(a["seq"] > b["seq"], 1).otherwise(0)))
    first = F.col("findings")[0]
    coded = ordered.withColumns({"smell_type": first["smell_type"], "code": first["code"], "tool": F.upper(first["tool"])})
    # by ranges, as most cases of a project may have one code
    return (
        number_rows(coded, [F.col("smell_key"), F.col("components")], "seq", by=("project", "code"))
        .withColumn("smell_id", numbered(F.concat("tool", F.lit("_"), "code", F.lit("_")), F.col("seq")))
        .withColumn("case_id", content_id(F.col("project"), F.col("smell_key"), F.array_join("components", "|")))
        .drop("tool")
    )


def _findings() -> Column:
    """The findings of a case with their number and evidence id: a suffix _n from the second one on."""

    def one(f: Column, i: Column) -> Column:
        base = numbered(F.concat(F.upper(f["tool"]), F.lit("_"), F.col("code"), F.lit("_")), F.col("seq"))
        n = i + 1
        own_id = F.concat(base, F.when(i > 0, F.concat(F.lit("_"), n.cast("string"))).otherwise(F.lit("")))
        return F.struct(n.alias("n"), *[f[c].alias(c) for c in ("tool", "tool_record_id", "source_file", "attributes")], own_id.alias("evidence_id"))

    return F.transform("findings", one)


def _carried() -> Column:
    """The metrics that the findings of a case carry."""
    known = lambda f: [F.struct(F.concat(f["evidence_id"], F.lit(f"_M_{m.upper()}")).alias("evidence_id"), F.lit("").alias("component"), F.lit(m).alias("name"), F.try_element_at(f["attributes"], F.lit(m)).alias("value"), f["tool"].alias("tool")) for m in ("atdi", "cycle_size", "severity")]
    return F.filter(F.flatten(F.transform(_findings(), lambda f: F.array(*known(f)))), lambda m: m["value"] != "")


def finding_rows(cases: DataFrame) -> DataFrame:
    """The findings of cases with their evidence ids."""
    return cases.select("case_id", F.inline(_findings()))


def edges_within(cases: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among a case's components, self-loops included.

    The cases' components are exploded and joined on the edge's start, so the
    work follows the matching edges and not cases times edges.
    """
    ends = cases.select("project", "case_id", "components", F.explode("components").alias("from_component"))
    return ends.join(edges, ["project", "from_component"]).filter(F.array_contains("components", F.col("to_component"))).drop("components")


def uncovered_pairs(cases: DataFrame, inside: DataFrame) -> DataFrame:
    """case_id, i, a, j, b: ordered pairs of different components of a case, by their places, that no edge joins in either direction.

    A component gets its neighbours and then the case's list, so the pairs, which
    are as many as the square of the components, are made last and not shuffled.
    """
    parts = cases.select("case_id", F.posexplode("components").alias("i", "a"))
    both = F.explode(F.array(F.struct(F.col("from_component").alias("a"), F.col("to_component").alias("b")), F.struct(F.col("to_component").alias("a"), F.col("from_component").alias("b"))))
    near = inside.select("case_id", both.alias("e")).groupBy("case_id", "e.a").agg(F.collect_set("e.b").alias("_near"))
    own = parts.join(near, ["case_id", "a"], "left").join(cases.select("case_id", "components"), "case_id")
    pairs = own.select("case_id", "i", "a", F.posexplode("components").alias("j", "b"), "_near")
    return pairs.filter("a <> b AND NOT coalesce(array_contains(_near, b), false)").drop("_near")


def first_open_pairs(cases: DataFrame, inside: DataFrame, most: int = NAMED_PAIRS) -> DataFrame:
    """case_id, n, a, b: the first `most` of a case's `uncovered_pairs` in order, without making the others.

    A component has as many open pairs as others without an edge to it. Sums of
    these numbers tell in which few components the first pairs are, and each of
    those needs no more of the case's list than its neighbours and `most` others.
    """
    parts = cases.select("case_id", F.posexplode("components").alias("i", "a"), F.size("components").alias("_size"))
    ends = inside.filter("from_component <> to_component").select("case_id", F.explode(F.array(F.struct(F.col("from_component").alias("a"), F.col("to_component").alias("b")), F.struct(F.col("to_component").alias("a"), F.col("from_component").alias("b")))).alias("e"))
    joined = ends.select("case_id", "e.a", "e.b").distinct()
    degrees = joined.groupBy("case_id", "a").agg(F.count("*").alias("_degree"))
    counted = parts.join(degrees, ["case_id", "a"], "left").withColumn("_degree", F.coalesce("_degree", F.lit(0))).withColumn("_open", F.col("_size") - 1 - F.col("_degree"))
    before = Window.partitionBy("case_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.withColumn("_before", F.coalesce(F.sum("_open").over(before), F.lit(0))).filter((F.col("_open") > 0) & (F.col("_before") < most))
    near = starts.join(cases.select("case_id", "components"), "case_id").select("case_id", "i", "a", F.posexplode(F.slice("components", F.lit(1), (F.col("_degree") + most + 1).cast("int"))).alias("j", "b"))
    found = near.filter("i <> j").join(joined, ["case_id", "a", "b"], "left_anti")
    n = F.row_number().over(Window.partitionBy("case_id").orderBy("i", "j"))
    return found.withColumn("n", n).filter(F.col("n") <= most).select("case_id", "n", "a", "b")


def limitations(cases: DataFrame, inside: DataFrame) -> DataFrame:
    """case_id, limitations (array) of the cases that have any.

    Cases of up to `SMALL_CASE` components find their first open pairs in the row; larger ones by `first_open_pairs`.
    """
    joined = inside.select("case_id", F.struct(F.least("from_component", "to_component").alias("a"), F.greatest("from_component", "to_component").alias("b")).alias("e")).groupBy("case_id").agg(F.collect_set("e").alias("_joined"))
    cyclic, small = (F.col("smell_key") == "cyclic_dependency") & (F.size("components") > 1), F.size("components") <= SMALL_CASE
    open_ = lambda a, b: (a != b) & ~F.array_contains("_joined", F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))
    of_one = lambda a: F.transform(F.filter("components", lambda b: F.coalesce(open_(a, b), a != b)), lambda b: F.concat(a, F.lit(" <-> "), b))
    pairs = F.when(cyclic & small, F.slice(F.flatten(F.transform("components", of_one)), 1, NAMED_PAIRS))
    rows = cases.select("case_id", "smell_key", "components").join(joined, "case_id", "left")
    large = cases.filter(cyclic & ~small)
    if large.limit(1).count():
        named = first_open_pairs(large, inside).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("n", F.concat("a", F.lit(" <-> "), "b").alias("pair")))).alias("_named"))
        rows, pairs = rows.join(named, "case_id", "left"), F.coalesce(pairs, F.col("_named.pair"))
    said = rows.select("case_id", pairs.alias("_pairs"), F.col("_joined").isNull().alias("_bare"))
    open_pairs = F.when(F.size("_pairs") > 0, F.concat(F.lit(OPEN_PAIRS), F.array_join("_pairs", ", "), F.lit(OPEN_PAIRS_END)))
    texts = F.array_compact(F.array(open_pairs, F.when(F.col("_bare"), F.lit(NO_EDGES))))
    return said.select("case_id", texts.alias("limitations")).filter(F.size("limitations") > 0)


def case_metrics(cases: DataFrame, metrics: DataFrame) -> DataFrame:
    """Metrics of cases: those that findings carry, then those of their components, numbered within the case."""
    return cases.select("case_id", F.inline(_carried())).unionByName(_component_metrics(cases, metrics))


def _component_metrics(cases: DataFrame, metrics: DataFrame) -> DataFrame:
    own = cases.select("case_id", "project", "smell_id", F.explode("components").alias("component")).join(metrics, ["project", "component"])
    order = Window.partitionBy("case_id").orderBy("component", "name", "value", "tool")
    return own.select("case_id", numbered(F.concat("smell_id", F.lit("_CM_")), F.row_number().over(order), 2).alias("evidence_id"), "component", "name", "value", "tool")


def build_cases(smells: DataFrame, edges: DataFrame, metrics: DataFrame, taxonomy: tuple = TAXONOMY) -> DataFrame:
    """Whole evidence cases as nested rows.

    Edges have project, from_component, to_component, evidence_id, relation_type, confidence, source,
    metrics project, component, name, value, tool.
    """
    cases = group_findings(smells, taxonomy)
    inside = edges_within(cases, edges)
    collect = lambda df, name, *cols: df.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    findings = F.transform(_findings(), lambda f: F.struct(*[f[c].alias(c) for c in ("n", "tool", "tool_record_id", "evidence_id", "source_file")], F.to_json(f["attributes"]).alias("attributes")))
    out = cases.withColumns({"tool_findings": findings, "_carried": _carried()}).drop("findings", "code", "seq")
    for part in (collect(inside, "dependency_evidence", "evidence_id", "from_component", "to_component", "relation_type", "confidence", "source"), collect(_component_metrics(cases, metrics), "_own", "evidence_id", "component", "name", "value", "tool"), limitations(cases, inside)):
        out = out.join(part, "case_id", "left")
    both = F.array_sort(F.when(F.col("_own").isNull(), F.col("_carried")).otherwise(F.concat("_carried", "_own")))
    return out.withColumn("metrics", F.when(F.size(both) > 0, both)).select(*[c for c in out.columns if c not in ("_carried", "_own", "limitations")], "metrics", "limitations")


def number_edges(edges: DataFrame, already: int, order: list[Column]) -> DataFrame:
    """Edges of one import, of one project and tool, with evidence ids that go on from the project's last number."""
    n = F.col("_n") + already
    return number_rows(edges, order, "_n").withColumn("evidence_id", numbered(F.concat(F.upper("tool"), F.lit("_EDGE_")), n)).drop("_n")
