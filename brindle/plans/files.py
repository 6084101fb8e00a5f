"""Queries that write exports from the standard tables, or fill a store of their own, and read them with the library."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import noisy_json, text
from brindle.functions.vocab import CRITERIA, INSTRUCTION, NO_EDGES, OPEN_PAIRS, OPEN_PAIRS_END
from brindle.operators import agents, analytics, exporting, graph, latest, normalize, splits
from brindle.operators.agents import MockModel
from brindle.plans.catalogue import _BUCKET, query
from brindle.plans.views import FACTORS, ORDER_CASES, PART_EDGES, REVIEWS, RUNS, order_cases, part_edges, ratio_sql, read, reviews, runs
from brindle.session import discard, release, shared_folder, written
from brindle.sources import exports, imports, listings, reviewing, skills, store, validation
from brindle.sources.calls import Calls
from brindle.sources.experiments import Model, run_experiment
from brindle.streaming import imports as stream

#: Files that a table is written to.
MANY = 120


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}/{name}"


def _csv(df: DataFrame, name: str, sep: str = ",", files: int = 8) -> str:
    """The table as delimited files with a header each, its columns as strings."""
    path = _folder(df.sparkSession, name)
    df.select(*[F.col(f"`{c}`").cast("string") for c in df.columns]).repartition(files).write.csv(path, header=True, sep=sep, quote='"', escape='"')
    return path


def _documents(df: DataFrame, name: str) -> str:
    """A file for each row's value."""
    path = _folder(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", 1).text(path)
    return path


NAMED, _named_edges = PART_EDGES, part_edges


@query("""SELECT CAST(p_partkey AS VARCHAR) AS tool_record_id, CASE p_size % 3 WHEN 0 THEN 'Cyclic Dependency' WHEN 1 THEN 'god class' ELSE 'Odd Smell' END AS smell_type_raw,
'org.' || p_brand || '|' || 'org, "x".' || (p_size % 7) AS affected_components, CAST(p_size AS VARCHAR) AS severity FROM part""")
def read_smells_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A smell file whose component lists are bracketed and hold commas and quotes."""
    size = F.col("p_size")
    label = F.when(size % 3 == 0, "Cyclic Dependency").when(size % 3 == 1, "god class").otherwise("Odd Smell")
    listed = F.concat(F.lit("[org."), "p_brand", F.lit(' ; org, "x".'), (size % 7).cast("string"), F.lit("]"))
    path = _csv(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("vertexId"), label.alias("smellType"), listed.alias("AffectedElements"), size.alias("Severity")), "smells.csv")
    found = exports.read_export(spark, path, "arcan")["smells"]
    return found.select("tool_record_id", "smell_type_raw", F.array_join("affected_components", "|").alias("affected_components"), F.element_at("attributes", "Severity").alias("severity"))


@query(f"WITH {NAMED} SELECT from_component, to_component, CASE WHEN weight % 2 = 0 THEN CAST(weight AS DOUBLE) END AS weight FROM named")
def read_edges_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge file split by semicolons; weights that are no numbers are null."""
    rows = _named_edges(spark, sf_dir).select(F.col("from_component").alias("Source"), F.col("to_component").alias("Target"), F.when(F.col("weight") % 2 == 0, F.col("weight").cast("string")).otherwise("many").alias("Weight"))
    return exports.read_export(spark, _csv(rows, "edges.csv", ";"), "arcan")["edges"].select("from_component", "to_component", "weight")


@query("""SELECT 'org.' || p_partkey AS component, 'FanIn' AS name, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT 'org.' || p_partkey, 'LinesOfCode', CAST(p_partkey * 3 AS VARCHAR) FROM part WHERE p_size % 2 = 0""")
def read_metrics_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide component metrics; empty ones give no row."""
    key = F.col("p_partkey")
    wide = read(spark, sf_dir, "part").select(F.concat(F.lit("org."), key.cast("string")).alias("name"), F.col("p_size").alias("FanIn"), F.when(F.col("p_size") % 2 == 0, key * 3).alias("LinesOfCode"))
    return exports.read_export(spark, _csv(wide, "metrics.csv"), "arcan")["metrics"].select("component", "name", "value")


@query("""SELECT 'Cyclic Dependency' AS smell_type_raw, 'org.' || p_partkey || '|org.' || replace(p_brand, '#', '') || '|lib.' || p_size AS affected_components FROM part WHERE p_partkey % 2 = 0
UNION ALL SELECT 'God Component', 'org.' || p_partkey FROM part WHERE p_partkey % 2 = 1""")
def read_prose_smells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smell files that tell a cycle's participants in a sentence."""
    even, package = F.col("p_partkey") % 2 == 0, F.concat(F.lit("org."), F.col("p_partkey").cast("string"))
    cause = F.concat(F.lit("A cycle between: org."), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(", lib."), F.col("p_size").cast("string"), F.lit("."))
    rows = read(spark, sf_dir, "part").select(F.lit("p").alias("Project"), package.alias("Package"), F.when(even, "Cyclic Dependency").otherwise("God Component").alias("Smell"), cause.alias("Description"))
    found = exports.read_export(spark, _csv(rows, "prose.csv"), "designite")["smells"]
    return found.select("smell_type_raw", F.array_join("affected_components", "|").alias("affected_components"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS tool_record_id, 'org.' || p_size || '|' || lower(p_name) AS affected_components, p_size AS severity FROM part""")
def read_many_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smells in 120 files, half of them with another delimiter and other headers, read as one export by as many tasks."""
    key, folder = F.col("p_partkey"), _folder(spark, "many")
    rows = read(spark, sf_dir, "part").select(key, F.lit("God Class").alias("type"), F.concat(F.lit("org."), F.col("p_size").cast("string"), F.lit("|"), F.lower("p_name")).alias("affected"), "p_size")
    for half, (sep, names) in enumerate(((",", ("ID", "Smell Type", "Affected-Elements", "Severity")), (";", ("vertex_id", "smell", "components", "severity_level")))):
        part = rows.filter(key % 2 == half).select(*[c.cast("string").alias(n) for c, n in zip((key, F.col("type"), F.col("affected"), F.col("p_size")), names, strict=True)])
        part.repartition(MANY // 2).write.csv(f"{folder}/{half}", header=True, sep=sep, quote='"', escape='"')
    found = exports.read_export(spark, f"{folder}/*/*.csv", "arcan")["smells"]
    return found.select("tool_record_id", F.array_join("affected_components", "|").alias("affected_components"), F.coalesce(F.try_element_at("attributes", F.lit("severity")), F.try_element_at("attributes", F.lit("Severity"))).cast("int").alias("severity"))


@query("""SELECT 'o' || o_orderkey AS tool_record_id, 'God' || chr(10) || repeat('x', CAST(o_orderkey % 5 AS INTEGER)) || chr(10) || 'Class' AS smell_type_raw, 'c' || o_custkey || '|org.x' AS affected_components FROM orders""")
def read_large_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smells of orders with line ends inside their quotes, in eight files that are read in slices of thirty kilobytes."""
    key = F.col("o_orderkey")
    kind = F.concat(F.lit("God\n"), F.repeat(F.lit("x"), (key % 5).cast("int")), F.lit("\nClass"))
    rows = read(spark, sf_dir, "orders").select(F.concat(F.lit("o"), key.cast("string")).alias("id"), kind.alias("smellType"), F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit(";org.x")).alias("affectedElements"))
    found = exports.read_smell_file(spark, _csv(rows, "large.csv"), slice_bytes=30_000)["smells"]
    return found.select("tool_record_id", "smell_type_raw", F.array_join("affected_components", "|").alias("affected_components"))


@query("""WITH w AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN '"' || p_size || '"' WHEN 2 THEN '"many"' WHEN 4 THEN '{"n":' || p_size || '}' END AS weight_json, p_size FROM part)
SELECT 'p' || p_partkey AS from_component, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS VARCHAR) ELSE 's' || p_size END AS to_component, CASE WHEN p_partkey % 5 < 2 THEN CAST(p_size AS DOUBLE) END AS weight, weight_json FROM w WHERE p_partkey % 7 <> 0""")
def read_loose_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges in JSON documents whose weights are numbers, texts, null and objects, whose ends are texts or numbers, among values that are no edges."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    weight = F.when(key % 5 == 0, size).when(key % 5 == 1, F.concat(F.lit('"'), size, F.lit('"'))).when(key % 5 == 2, '"many"').when(key % 5 == 3, "null").otherwise(F.concat(F.lit('{"n": '), size, F.lit("}")))
    end = F.when(key % 3 == 0, size).otherwise(F.concat(F.lit('"s'), size, F.lit('"')))
    edge = F.when(key % 7 == 0, F.element_at(F.array(*map(F.lit, ('"text"', "7", "null", '{"from": "", "to": "x"}', '["a", "b"]'))), (key % 5 + 1).cast("int"))).otherwise(F.concat(F.lit('{"from": "p'), key.cast("string"), F.lit('", "to": '), end, F.lit(', "weight": '), weight, F.lit("}")))
    docs = read(spark, sf_dir, "part").groupBy((key / 50).cast("int").alias("doc")).agg(F.collect_list(edge).alias("edges"))  # fifty a document
    path = _documents(docs.select(F.concat(F.lit('{"edges": ['), F.array_join("edges", ", "), F.lit("]}")).alias("value")), "loose.json")
    return exports.read_export(spark, path, "arcan")["edges"].select("from_component", "to_component", "weight", "weight_json")


@query(f"WITH {NAMED} SELECT from_component, to_component, CAST(weight AS DOUBLE) AS weight FROM named")
def read_graph_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _named_edges(spark, sf_dir).withColumnsRenamed({"from_component": "from", "to_component": "to"})
    return exports.read_export(spark, _csv(edges, "graph.csv", "\t"), "static_graph")["edges"].select("from_component", "to_component", "weight")


def _block() -> Column:
    """Components whose edges lie in one document: two hundred."""
    return (F.substring_index("from_component", ".", -1).cast("long") / 200).cast("long").alias("block")


@query(f"WITH {NAMED} SELECT from_component, to_component FROM named")
def read_graph_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maps from each component to those that it uses, alone or in a list, a document for each two hundred components."""
    targets = _named_edges(spark, sf_dir).groupBy("from_component").agg(F.collect_list(F.concat(F.lit('"'), "to_component", F.lit('"'))).alias("to"))
    entry = F.concat(F.lit('"'), "from_component", F.lit('": '), F.when(F.size("to") == 1, F.col("to")[0]).otherwise(F.concat(F.lit("["), F.array_join("to", ", "), F.lit("]"))))
    docs = targets.groupBy(_block()).agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ", "), F.lit("}")).alias("value")).select("value")
    return exports.read_export(spark, _documents(docs, "graph.json"), "static_graph")["edges"].select("from_component", "to_component")


@query(f"WITH {NAMED} SELECT from_component, to_component FROM named")
def read_graph_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit('"'), "from_component", F.lit('" -> "'), "to_component", F.lit('";'))
    docs = _named_edges(spark, sf_dir).groupBy(_block()).agg(F.concat(F.lit("digraph g {\n"), F.array_join(F.collect_list(line), "\n"), F.lit("\n}")).alias("value")).select("value")
    return exports.read_export(spark, _documents(docs, "graph.dot"), "static_graph")["edges"].select("from_component", "to_component")


@query(f"""WITH {NAMED}, {ORDER_CASES} SELECT 'smell' AS kind, 's' || order_key AS a, array_to_string(components, '|') AS b, 'area ' || order_key % 9 AS c FROM order_cases
UNION ALL SELECT 'edge', from_component, to_component, CAST(CAST(weight AS DOUBLE) AS VARCHAR) FROM named""")
def read_smell_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smells with lists of components, and edges, in many documents."""
    found = exports.read_export(spark, _documents(_smell_documents(spark, sf_dir), "smells.json"), "arcan")
    smells = found["smells"].select(F.lit("smell").alias("kind"), F.col("tool_record_id").alias("a"), F.array_join("affected_components", "|").alias("b"), F.element_at("attributes", "area").alias("c"))
    return smells.unionByName(found["edges"].select(F.lit("edge").alias("kind"), F.col("from_component").alias("a"), F.col("to_component").alias("b"), F.col("weight").cast("string").alias("c")))


def _smell_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """value: JSON documents of the orders' cases, a thousand orders each, and of the edges of two hundred parts each."""
    key = F.col("order_key")
    smell = F.struct(F.concat(F.lit("s"), key.cast("string")).alias("id"), F.lit("Cyclic Dependency").alias("smellType"), F.col("components").alias("affectedElements"), F.concat(F.lit("area "), (key % 9).cast("string")).alias("area"))
    smells = order_cases(spark, sf_dir).groupBy((key / 1000).cast("long").alias("block")).agg(F.to_json(F.struct(F.collect_list(smell).alias("smells"))).alias("value"))
    edge = F.struct(F.col("from_component").alias("from"), F.col("to_component").alias("to"), "weight")
    edges = _named_edges(spark, sf_dir).groupBy(_block()).agg(F.to_json(F.struct(F.collect_list(edge).alias("edges"))).alias("value"))
    return smells.select("value").unionByName(edges.select("value"))


@query("SELECT 'csv' AS kind, sha256(s_name || chr(10)) AS sha256 FROM supplier")
def file_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of the CSV and JSON files below a folder; others in it are passed over."""
    folder, rows = _folder(spark, "found"), read(spark, sf_dir, "supplier").select("s_name")
    rows.repartition(5).write.option("header", "false").option("maxRecordsPerFile", 1).csv(f"{folder}/a")
    rows.write.text(f"{folder}/b")
    return exports.read_folder(spark, folder).select(F.substring_index("path", ".", -1).alias("kind"), "sha256")


_CASES = f"""{NAMED}, {ORDER_CASES}, r AS (SELECT components, count(*) AS n_findings FROM order_cases GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY components) AS seq, substr(sha1('demo|cyclic_dependency|' || array_to_string(components, '|')), 1, 16) AS case_id FROM r),
inside AS (SELECT case_id, count(*) AS n_edges FROM (SELECT case_id, components, unnest(components) AS from_component FROM k) JOIN named USING (from_component) WHERE list_contains(components, to_component) GROUP BY 1)"""


def _imported(spark: SparkSession, sf_dir: str) -> str:
    """A store into which the orders' smells and the edges were imported, the smells twice."""
    root = _folder(spark, "store")
    smells = order_cases(spark, sf_dir).select(F.col("order_key").alias("id"), F.lit("Cyclic Dependency").alias("smell"), F.array_join("components", ";").alias("affected"), F.lit("high").alias("severity"))
    path = _csv(smells, "smells.csv")
    for file, tool in ((path, "arcan"), (path, "arcan"), (_csv(_named_edges(spark, sf_dir), "graph.csv"), "static_graph")):
        imports.import_file(spark, root, "demo", tool, f"{file}/*.csv")
    return root


@query(f"""WITH {_CASES} SELECT case_id, 'ARCAN_CD_' || format('{{:03d}}', seq) AS smell_id, array_to_string(components, '|') AS components, n_findings, coalesce(n_edges, 0) AS n_edges, n_findings AS n_metrics FROM k LEFT JOIN inside USING (case_id)""")
def import_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files imported into the store, and the evidence cases made of what is stored."""
    root = _imported(spark, sf_dir)
    imports.save_cases(imports.stored_cases(spark, root, "demo"), root)
    case = "components array<string>, tool_findings array<string>, dependency_evidence array<string>, metrics array<string>"
    cases = store.current(spark, root, "evidence_cases", "demo").withColumn("c", F.from_json("case_json", case))
    return cases.select("case_id", "smell_id", F.array_join("c.components", "|").alias("components"), F.size("c.tool_findings").cast("long").alias("n_findings"), F.greatest(F.lit(0), F.coalesce(F.size("c.dependency_evidence"), F.lit(0))).cast("long").alias("n_edges"), F.size("c.metrics").cast("long").alias("n_metrics"))


@query(f"""WITH {NAMED}, {ORDER_CASES}, s AS (SELECT count(*) AS n FROM order_cases), e AS (SELECT count(*) AS n FROM named)
SELECT 'raw_findings' AS name, s.n + e.n AS n FROM s, e UNION ALL SELECT 'graph_edges', n FROM e UNION ALL SELECT 'tool_runs', 2 UNION ALL SELECT 'audit_log', 2 UNION ALL SELECT 'last_edge', n FROM e""")
def import_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What imports leave in the store's tables: content that was imported before isn't read again. The last edge's number is the number of edges."""
    root = _imported(spark, sf_dir)
    last = store.current(spark, root, "graph_edges", "demo").agg(F.lit("last_edge").alias("name"), F.max(F.substring_index("evidence_id", "_", -1).cast("long")).alias("n"))
    return exports.union_all([*[store.current(spark, root, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in ("raw_findings", "graph_edges", "tool_runs", "audit_log")], last])


@query(f"WITH {_CASES} SELECT case_id, array_to_string(components, '|') AS components, coalesce(n_edges, 0) AS n_edges FROM k LEFT JOIN inside USING (case_id)")
def stream_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cases from JSON files that a stream imported."""
    root, incoming = _folder(spark, "store"), _documents(_smell_documents(spark, sf_dir), "incoming")
    stream.import_stream(spark, incoming, root, "demo", "arcan", _folder(spark, "checkpoint"), pattern="*.txt").awaitTermination()
    cases = imports.stored_cases(spark, root, "demo")
    return cases.select("case_id", F.array_join("components", "|").alias("components"), F.coalesce(F.size("dependency_evidence"), F.lit(0)).cast("long").alias("n_edges"))


@query(f"""WITH {NAMED}, {ORDER_CASES}, few AS (SELECT * FROM named WHERE weight > 1),
p AS (SELECT order_key, components, i, unnest(range(1, len(components) + 1)) AS j FROM (SELECT *, unnest(range(1, len(components) + 1)) AS i FROM order_cases)),
o AS (SELECT order_key, components[i] AS a, components[j] AS b, row_number() OVER (PARTITION BY order_key ORDER BY i, j) AS n FROM p WHERE i <> j AND NOT EXISTS (SELECT 1 FROM few WHERE from_component = components[i] AND to_component = components[j]) AND NOT EXISTS (SELECT 1 FROM few WHERE from_component = components[j] AND to_component = components[i])),
h AS (SELECT DISTINCT order_key FROM (SELECT order_key, components, unnest(components) AS from_component FROM order_cases) JOIN few USING (from_component) WHERE list_contains(components, to_component)),
t AS (SELECT order_key, 0 AS k, '{OPEN_PAIRS}' || string_agg(a || ' <-> ' || b, ', ' ORDER BY n) || '{OPEN_PAIRS_END}' AS line FROM o WHERE n <= 5 GROUP BY 1 UNION ALL SELECT order_key, 1, '{NO_EDGES}' FROM order_cases WHERE order_key NOT IN (SELECT order_key FROM h))
SELECT order_key AS case_id, string_agg(line, '|' ORDER BY k) AS limitations FROM t GROUP BY 1""")
def case_limitations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cases say about pairs that no edge joins."""
    cases = order_cases(spark, sf_dir).select(F.col("order_key").alias("case_id"), F.lit("demo").alias("project"), F.lit("cyclic_dependency").alias("smell_key"), "components")
    few = _named_edges(spark, sf_dir).filter("weight > 1").withColumn("project", F.lit("demo"))
    return normalize.limitations(cases, normalize.edges_within(cases, few)).select("case_id", F.array_join("limitations", "|").alias("limitations"))


@query(f"""WITH {ORDER_CASES}, f AS (SELECT components, count(*) AS n_findings FROM order_cases GROUP BY 1), c AS (SELECT *, 'ARCAN_CD_' || format('{{:03d}}', row_number() OVER (ORDER BY components)) AS smell_id FROM f),
m AS (SELECT 'org.' || p_partkey AS component, unnest(['name', 'size']) AS name, unnest([p_name, CAST(p_size AS VARCHAR)]) AS value FROM part),
own AS (SELECT smell_id, component, name, value FROM (SELECT smell_id, unnest(components) AS component FROM c) JOIN m USING (component))
SELECT smell_id || CASE WHEN k > 1 THEN '_' || k ELSE '' END || '_M_SEVERITY' AS evidence_id, '' AS component, 'severity' AS name, 'high' AS value FROM (SELECT smell_id, unnest(range(1, n_findings + 1)) AS k FROM c)
UNION ALL SELECT smell_id || '_CM_' || format('{{:02d}}', row_number() OVER (PARTITION BY smell_id ORDER BY component, name, value)), component, name, value FROM own""")
def metric_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics that findings carry and those of a case's components, under numbers within the case."""
    smells = order_cases(spark, sf_dir).select(F.lit("demo").alias("project"), F.col("order_key").cast("string").alias("seq"), F.lit("arcan").alias("tool"), F.lit("x").alias("tool_record_id"), F.lit("f").alias("source_file"), F.lit("Cyclic Dependency").alias("smell_type_raw"), F.col("components").alias("affected_components"), F.create_map(F.lit("severity"), F.lit("high")).alias("attributes"))
    metrics = read(spark, sf_dir, "part").select(F.lit("demo").alias("project"), F.concat(F.lit("org."), F.col("p_partkey").cast("string")).alias("component"), F.explode(F.create_map(F.lit("name"), F.col("p_name"), F.lit("size"), F.col("p_size").cast("string"))).alias("name", "value"), F.lit("arcan").alias("tool"))
    return normalize.case_metrics(normalize.group_findings(smells), metrics).select("evidence_id", "component", "name", "value")


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases as JSON, one for each order, with the edges inside it."""
    smells = order_cases(spark, sf_dir).select(F.col("order_key").cast("string").alias("case_id"), F.lit("demo").alias("project"), "components", F.col("order_key").alias("k"))
    edges = _named_edges(spark, sf_dir).select(F.lit("demo").alias("project"), "from_component", "to_component", F.concat_ws("_", F.lit("E"), "from_component", "to_component").alias("evidence_id"))
    inside = normalize.edges_within(smells, edges).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("evidence_id", "from_component", "to_component"))).alias("dependency_evidence"))
    whole = smells.join(inside, "case_id", "left")
    document = F.to_json(F.struct(F.lit("cyclic_dependency").alias("smell_key"), "components", F.col("components").alias("affected_components"), "dependency_evidence"))
    version = F.concat(F.lit("v"), (F.col("k") % 3).cast("string"))
    return whole.select("case_id", "project", F.concat(F.lit("S"), F.col("case_id")).alias("smell_id"), F.lit("cyclic_dependency").alias("smell_key"), document.alias("case_json"), F.lit("Cut the weakest edge.").alias("skill_text"), version.alias("skill_version"), F.when(F.col("k") % 4 == 0, "validation").otherwise("train").alias("split"))


_ORDER_EDGES = f"""{NAMED}, {ORDER_CASES}, x AS (SELECT order_key, count(*) AS n FROM (SELECT order_key, components, unnest(components) AS from_component FROM order_cases) JOIN named USING (from_component) WHERE list_contains(components, to_component) GROUP BY 1),
i AS (SELECT CAST(order_key AS VARCHAR) AS case_id, order_key AS k, len(components) AS n_components, coalesce(n, 0) AS n FROM order_cases LEFT JOIN x USING (order_key))"""


class _Vague:
    """A model that never gives an object it is asked for."""

    def answer(self, system: str, user: str) -> str:
        return "I would rather not." if "Your answer" not in user else '{"recommended_refactoring": "Rewrite", "rationale": "x"}'


@query(f"""WITH {_ORDER_EDGES} SELECT case_id, 'tool_evidence' AS agent_mode, 'ok' AS status, false AS repair_attempted, 'Dependency Inversion' AS recommended, CASE WHEN n > 0 THEN n ELSE n_components END + 1 AS n_steps, n AS n_evidence FROM i
UNION ALL SELECT case_id, 'baseline', 'invalid_json', true, 'none', 0, 0 FROM i""")
def agent_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of agents with the offline model, and of one whose answers can't be used even after a repair."""
    cases = written(_cases(spark, sf_dir), "cases")
    made = agents.run_agents(cases, "tool_evidence").unionByName(agents.run_agents(cases, "baseline", _Vague))
    discard(cases)
    s = F.col("suggestion")
    size = lambda c: F.when(s.isNotNull(), F.size(c)).otherwise(0).cast("long")
    return made.select("case_id", "agent_mode", "status", "repair_attempted", F.coalesce(s["recommended_refactoring"], F.lit("none")).alias("recommended"), size(s["implementation_steps"]).alias("n_steps"), size(s["evidence_used"]).alias("n_evidence"))


class _Careless(MockModel):
    """Names no risk where a case has an even number of components, cites unknown evidence where the number can be divided by three."""

    def answer(self, system: str, user: str) -> str:
        own = json.loads(super().answer(system, user))
        n = len(own["affected_components"])
        own |= {"risks_and_tradeoffs": []} if n % 2 == 0 else {}
        own |= {"evidence_used": ["E99"]} if n % 3 == 0 else {}
        return json.dumps(own)


def _saved_runs(spark: SparkSession, sf_dir: str) -> str:
    """A store with the orders' cases, runs of a careless agent over them, and their checks made anew."""
    root, cases = _folder(spark, "store"), written(_cases(spark, sf_dir), "cases")
    store.append(cases, root, "evidence_cases")
    release(spark)
    made = agents.run_agents(cases, "skill", _Careless, calls=Calls(root))
    discard(cases)
    reviewing.save_runs(made.withColumn("skill_name", F.lit("BreakCyclicDependencySkill")), root)
    discard(made)
    reviewing.rescore(spark, root, "demo")
    return root


@query(f"""WITH {_ORDER_EDGES} SELECT case_id, 'ok' AS status, n_components % 3 = 0 AS critical_hallucination, CASE WHEN n_components % 3 = 0 THEN 1 WHEN n > 0 THEN 5 ELSE 3 END AS evidence_grounding, 4 AS refactoring_relevance, n > 0 AS direction_known FROM i""")
def rescored_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored runs checked again from their stored suggestions and cases, read back from the store."""
    root = _saved_runs(spark, sf_dir)
    made = store.current(spark, root, "agent_runs", "demo").join(store.current(spark, root, "suggested_scores").select("run_id", "scores_json"), "run_id")
    value = lambda document, field: F.get_json_object(document, f"$.{field}")
    return made.select(
        "case_id", "status", value("checks_json", "critical_hallucination").cast("boolean").alias("critical_hallucination"),
        value("scores_json", "evidence_grounding").cast("int").alias("evidence_grounding"), value("scores_json", "refactoring_relevance").cast("int").alias("refactoring_relevance"),
        (value("suggestion_json", "candidate_boundary_to_inspect.edge_direction_status") == "supported_by_evidence").alias("direction_known"),
    )


_SHARE = "count(*) FILTER (WHERE {})"


@query(f"""WITH {_ORDER_EDGES}, r AS (SELECT 'v' || k % 3 AS skill_version, n_components % 3 = 0 AS wrong, CASE WHEN n > 0 THEN n ELSE n_components END + 1 < 3 AS few, n_components % 2 = 0 AS safe FROM i)
SELECT skill_version, {ratio_sql(_SHARE.format("wrong"), "count(*)", 3)} AS unsupported_evidence_claim_rate, {ratio_sql(_SHARE.format("few"), "count(*)", 3)} AS missing_steps_rate, {ratio_sql(_SHARE.format("safe"), "count(*)", 3)} AS risk_omission_rate FROM r GROUP BY 1""")
def failure_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of failed checks by skill version, from what rescoring left in the store."""
    found = reviewing.found_checks(store.current(spark, _saved_runs(spark, sf_dir), "agent_runs", "demo"))
    return analytics.failure_rates(found, ["skill_version"]).drop("mean_total_tokens", "mean_runtime_seconds")


@query(f"""WITH {_ORDER_EDGES}, m AS (SELECT *, CASE WHEN k % 2 = 0 THEN 4 ELSE 2 END AS score FROM i)
SELECT 'v' || k % 3 AS skill_version, count(*) AS reviews_aggregated, {ratio_sql("sum(score * 1000)", "(count(*) * 1000)", 3)} AS mean_hgrs, {ratio_sql("100 * " + _SHARE.format("k % 2 = 0"), "count(*)", 1)} AS would_try_yes_pct,
  {ratio_sql(_SHARE.format("n_components % 2 = 0"), "count(*)", 3)} AS risk_omission_rate, CASE WHEN sum(score) * 2 < 7 * count(*) THEN 7 ELSE 0 END AS n_weak, least(3, count(*)) AS n_lowest, 'boundary' AS first_complaint FROM m GROUP BY 1""")
def stored_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of stored runs digested for each skill version, read back from the store."""
    root = _saved_runs(spark, sf_dir)
    even = F.col("case_id").cast("long") % 2 == 0
    rows = store.current(spark, root, "agent_runs", "demo").select("run_id", F.concat(F.lit("r"), "run_id").alias("review_id"), F.lit("me").alias("reviewer"), *[F.when(even, 4).otherwise(2).alias(c) for c in CRITERIA], F.when(even, "yes").otherwise("no").alias("would_try_it"), F.lit("accept").alias("decision"), F.lit("Wrong boundary, no boundary at all").alias("reviewer_notes"))
    discard(reviewing.save_reviews(rows, root))
    validation.save_digests(spark, root)
    whole = "reviews_aggregated long, mean_hgrs double, would_try_yes_pct double, risk_omission_rate double, weak_criteria array<string>, lowest_rated_outputs array<string>, common_reviewer_complaints array<struct<term string>>"
    read_back = store.current(spark, root, "feedback_digests").withColumn("d", F.from_json("digest_json", whole))
    return read_back.select("skill_version", "d.reviews_aggregated", "d.mean_hgrs", "d.would_try_yes_pct", "d.risk_omission_rate", F.size("d.weak_criteria").alias("n_weak"), F.size("d.lowest_rated_outputs").cast("long").alias("n_lowest"), F.col("d.common_reviewer_complaints")[0]["term"].alias("first_complaint"))


def _skills(spark: SparkSession, root: str, **texts: str) -> None:
    for version, skill in texts.items():
        store.append_row(spark, root, "skills", name="BreakCyclicDependencySkill", version=version, status="production" if version == "v0" else "candidate", text=skill)


@query(f"""WITH {_ORDER_EDGES}, g AS (SELECT unnest([('baseline', 'none'), ('skill', 'v0'), ('skill', 'v1')]) AS g)
SELECT case_id, g[1] AS agent_mode, g[2] AS skill_version, m.model_id, CASE WHEN m.model_id = 'vague' THEN 'invalid_json' ELSE 'ok' END AS status FROM i, g, (SELECT unnest(['mock', 'vague']) AS model_id) m WHERE k % 4 = 0""")
def experiment_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An experiment over held-out cases: every mode, skill version and model, each with so many tasks that call."""
    root = _folder(spark, "store")
    store.append(_cases(spark, sf_dir), root, "evidence_cases")
    _skills(spark, root, v0="Cut the weakest edge.", v1="Cut the newest edge.")
    made = run_experiment(spark, root, "grid", "demo", {"mock": Model(concurrency=4), "vague": Model(_Vague, concurrency=2)}, ["baseline", "skill"], [None, "v1"], "validation")
    return store.current(spark, root, "agent_runs", "demo").filter(F.col("experiment_id") == made).select("case_id", "agent_mode", "skill_version", "model_id", "status")


class _Improved(_Careless):
    """Without mistakes where the candidate's text is given."""

    def answer(self, system: str, user: str) -> str:
        return MockModel.answer(self, system, user) if "newest" in system else super().answer(system, user)


@query(f"""WITH {_ORDER_EDGES}, c AS (SELECT * FROM i WHERE k % 4 = 0), n AS (SELECT count(*) AS n, count(*) FILTER (WHERE n_components % 3 = 0) AS wrong,
  sum(CASE WHEN n > 0 THEN 5 ELSE 3 END) AS good, sum(CASE WHEN n_components % 3 = 0 THEN 1 WHEN n > 0 THEN 5 ELSE 3 END) AS bad FROM c)
SELECT version, n AS n_scored, CASE WHEN version = 'v0' THEN wrong ELSE 0 END AS critical_hallucinations, CASE WHEN version = 'v0' THEN {ratio_sql("bad * 1000", "(n * 1000)", 3)} ELSE {ratio_sql("good * 1000", "(n * 1000)", 3)} END AS mean_grounding, 'deterministic_proxy' AS score_sources, n AS cases_run FROM n, (SELECT unnest(['v0', 'v1_candidate']) AS version)""")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a skill run on the held-out cases, scored and compared; what the stored report says of each."""
    root = _folder(spark, "store")
    store.append(_cases(spark, sf_dir), root, "evidence_cases")
    _skills(spark, root, v0="Cut the weakest edge.", v1_candidate="Cut the newest edge.")
    report = validation.validate(spark, root, "demo", "BreakCyclicDependencySkill", "v0", "v1_candidate", _Improved)
    side = "struct<version string, n_scored long, critical_hallucinations long, mean_grounding double, score_sources array<string>>"
    found = store.current(spark, root, "validation_reports").filter(F.col("report_id") == report).select(F.from_json("report_json", f"cases_run long, baseline {side}, candidate {side}").alias("r"))
    return found.select("r.cases_run", F.explode(F.array("r.baseline", "r.candidate")).alias("s")).select("s.version", "s.n_scored", "s.critical_hallucinations", "s.mean_grounding", F.array_join("s.score_sources", "|").alias("score_sources"), "cases_run")


@query(f"WITH {_ORDER_EDGES} SELECT case_id AS entity, 'vague answer quarantined' AS what FROM i WHERE k % 2 = 1")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that couldn't be used even after a repair, as the store keeps them."""
    root, cases = _folder(spark, "store"), written(_cases(spark, sf_dir).filter("CAST(case_id AS long) % 2 = 1"), "cases")
    store.append(cases, root, "evidence_cases")
    reviewing.save_runs(agents.run_agents(cases, "baseline", _Vague, calls=Calls(root, "vague")), root)
    kept = store.current(spark, root, "malformed_outputs").filter("raw_text <> '' AND error <> ''").select("run_id")
    return store.current(spark, root, "agent_runs", "demo").join(kept, "run_id").select(F.col("case_id").alias("entity"), F.lit("vague answer quarantined").alias("what"))


@query("""SELECT 'p' || user_id % 20 AS project, 'c' || event_id AS case_id, CASE WHEN user_id % 20 = 3 THEN 'rewritten' WHEN event_id % 3 = 0 THEN 'changed' ELSE 'first' END AS case_json FROM events WHERE user_id % 20 <> 5""")
def project_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of twenty projects: one project folded, one rewritten and one cleared without touching the others."""
    root, key = _folder(spark, "store"), F.col("event_id")
    rows = read(spark, sf_dir, "events").select(F.concat(F.lit("p"), (F.col("user_id") % 20).cast("string")).alias("project"), F.concat(F.lit("c"), key.cast("string")).alias("case_id"), F.lit("first").alias("case_json"), "event_id")
    store.append(rows, root, "evidence_cases")
    store.append(rows.filter(key % 3 == 0).withColumn("case_json", F.lit("changed")), root, "evidence_cases")
    store.compact(spark, root, "evidence_cases", "p4")
    store.replace(store.current(spark, root, "evidence_cases", "p3").withColumn("case_json", F.lit("rewritten")), root, "evidence_cases", "p3")
    store.clear_cases(spark, root, "p5")
    return store.current(spark, root, "evidence_cases").select("project", "case_id", "case_json")


@query("""SELECT 'p' || o_custkey AS project, min(o_orderpriority) AS architecture_type FROM orders GROUP BY 1""")
def added_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects are added once: what a second import says of them changes nothing."""
    root = _folder(spark, "store")
    rows = read(spark, sf_dir, "orders").groupBy(F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("project")).agg(F.min("o_orderpriority").alias("architecture_type"))
    store.add_projects(rows.filter("project < 'p5'"), root)
    store.add_projects(rows, root)
    store.add_projects(rows.withColumn("architecture_type", F.lit("other")), root)
    return store.current(spark, root, "projects").select("project", "architecture_type")


@query(f"""WITH r AS (SELECT 'r' || o_orderkey AS run_id, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'P' THEN 'invalid_json' ELSE 'error' END AS status, 'm' || o_custkey % 3 AS model_id FROM orders)
SELECT 'status' AS facet, status AS value, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'model_id', model_id, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'agent_mode', NULL, count(*) FROM r UNION ALL SELECT 'skill_version', NULL, count(*) FROM r""")
def run_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values by which the list of stored runs is narrowed."""
    root = _folder(spark, "store")
    store.append(runs(spark, sf_dir).select(F.concat(F.lit("r"), F.col("run_id").cast("string")).alias("run_id"), "status", "model_id"), root, "agent_runs")
    return listings.choices(spark, root, "agent_runs")


_SCORES = {c: f"1 + (CAST(l_quantity AS BIGINT) * {a} + l_linenumber * {b} + l_partkey * {d}) % 5" for c, (a, b, d) in zip(CRITERIA, FACTORS, strict=True)}


@query(f"""WITH {REVIEWS}, k AS (SELECT *, run_id || '-' || row_number() OVER (PARTITION BY run_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS review_id FROM reviews)
SELECT review_id, run_id, CASE WHEN l_partkey % 9 = 0 THEN 5.0 ELSE hgrs END AS hgrs, decision FROM k WHERE run_id % 7 <> 0 AND l_linenumber <> 6""")
def saved_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews saved in the store, some of them changed later; those of unknown runs and with scores out of range are refused."""
    root = _folder(spark, "store")
    store.append(runs(spark, sf_dir).filter("run_id % 7 <> 0").select(F.col("run_id").cast("string").alias("run_id"), "status"), root, "agent_runs")
    n = F.row_number().over(Window.partitionBy("run_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"))
    rows = reviews(spark, sf_dir).withColumn("review_id", F.concat_ws("-", F.col("run_id").cast("string"), n.cast("string"))).withColumns({"run_id": F.col("run_id").cast("string"), "reviewer": F.lit("r")})
    rows = rows.withColumn(CRITERIA[0], F.when(F.col("l_linenumber") == 6, 9).otherwise(F.col(CRITERIA[0])))
    # numbered once; what was refused isn't read
    rows = written(rows.select("review_id", "run_id", "reviewer", *CRITERIA, "would_try_it", "decision", (F.expr("l_partkey % 9 = 0 AND l_linenumber <> 6")).alias("best")), "numbered")
    release(spark)
    discard(reviewing.save_reviews(rows.drop("best"), root))
    best = rows.filter("best").drop("best").withColumns({c: F.lit(5) for c in CRITERIA})
    discard(reviewing.save_reviews(best, root))
    discard(rows)
    return store.current(spark, root, "reviews").select("review_id", F.col("run_id").cast("long").alias("run_id"), "hgrs", "decision")


@query("""SELECT 'r' || event_id AS run_id, 'a' AS source, CASE WHEN event_id % 3 = 0 THEN props ELSE '0' END AS scores_json FROM events WHERE event_id % 5 <> 0""")
def store_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, partial changes and removals in the store, and what is current."""
    root, key = _folder(spark, "store"), F.col("event_id")
    rows = read(spark, sf_dir, "events").select(F.concat(F.lit("r"), key.cast("string")).alias("run_id"), F.lit("a").alias("source"), F.lit("0").alias("scores_json"), "props", "event_id")
    store.append(rows, root, "suggested_scores")
    store.append(rows.filter(key % 3 == 0).withColumn("scores_json", F.col("props")), root, "suggested_scores")
    store.append(rows.filter(key % 2 == 0).select("run_id", "source"), root, "suggested_scores")
    store.append(rows.filter(key % 5 == 0).select("run_id", "source", F.lit(True).alias("removed")), root, "suggested_scores")
    return store.current(spark, root, "suggested_scores").select("run_id", "source", "scores_json")


@query("""WITH s AS (SELECT p_brand || p_size AS name, 'v' || p_partkey AS version, p_partkey % 7 = 0 AS there FROM part),
f AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY version) AS n FROM s WHERE NOT there)
SELECT name, version, CASE WHEN n = 1 AND name NOT IN (SELECT name FROM s WHERE there) THEN 'production' ELSE 'archived' END AS status FROM f""")
def skill_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills found in a folder against those registered: a name's first version becomes production if none is."""
    found = read(spark, sf_dir, "part").select(F.concat("p_brand", F.col("p_size").cast("string")).alias("name"), F.concat(F.lit("v"), F.col("p_partkey").cast("string")).alias("version"), F.lit("f").alias("file_path"), F.lit("text").alias("text"), "p_partkey")
    there = found.filter("p_partkey % 7 = 0").withColumn("status", F.lit("production"))
    return skills.new_skills(found, there).select("name", "version", "status")


@query("""SELECT 'S' || p_partkey AS name, 'v' || (p_size + 1) || '_candidate' AS version, 'v' || p_size AS parent_version, '# ' || p_name AS head FROM part WHERE p_partkey % 2 = 0""")
def skill_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates from what an optimizer answered: fences off, too short ones out."""
    key = F.col("p_partkey")
    fence, long = F.lit("```markdown\n# "), F.when(key % 2 == 0, F.repeat(F.lit(" word"), F.lit(60))).otherwise("")
    answers = read(spark, sf_dir, "part").select(F.concat(F.lit("S"), key.cast("string")).alias("name"), F.concat(F.lit("v"), F.col("p_size").cast("string")).alias("version"), F.concat(fence, "p_name", F.lit("\n"), long, F.lit("\n```")).alias("answer"))
    return skills.revised(answers).select("name", "version", "parent_version", F.substring_index("text", "\n", 1).alias("head"))


class _Writer:
    """Writes a skill anew with as many words as its request has."""

    def answer(self, system: str, user: str) -> str:
        return "```markdown\n# New skill\n" + "word " * len(user) + "\n```"


@query("""SELECT 'S' || p_partkey AS name, 'v' || (p_size + 1) || '_candidate' AS version, 'candidate' AS status, 'from digest d' || p_partkey AS notes FROM part WHERE p_partkey % 3 = 0""")
def registered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills with a digest, revised by a model and registered as candidates."""
    root, key = _folder(spark, "store"), F.col("p_partkey").cast("string")
    rows = read(spark, sf_dir, "part").select(F.concat(F.lit("S"), key).alias("name"), F.concat(F.lit("v"), F.col("p_size").cast("string")).alias("version"), F.lit("production").alias("status"), F.lit("old text").alias("text"), F.concat(F.lit("d"), key).alias("digest_id"), "p_partkey")
    store.append(rows, root, "skills")
    digests = rows.filter("p_partkey % 3 = 0").select("digest_id", F.col("name").alias("skill_name"), F.col("version").alias("skill_version"), F.lit('{"weak_criteria": []}').alias("digest_json"))
    store.append(digests, root, "feedback_digests")
    skills.add_candidates(spark, root, None, _Writer, Calls(root, "writer"))
    return store.current(spark, root, "skills").filter("status = 'candidate'").select("name", "version", "status", "notes")


@query("""WITH s AS (SELECT p_brand AS name, 'v' || p_partkey AS version, CASE WHEN p_partkey % 4 = 0 THEN 'production' ELSE 'archived' END AS status, p_partkey FROM part)
SELECT name, max_by(version, version) AS version FROM s WHERE status = 'production' GROUP BY 1""")
def live_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The production version of each name from the store; those registered at one time fall to the greater version."""
    root, key = _folder(spark, "store"), F.col("p_partkey")
    store.append(read(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.concat(F.lit("v"), key.cast("string")).alias("version"), F.when(key % 4 == 0, "production").otherwise("archived").alias("status"), F.lit("t").alias("text")), root, "skills")
    return skills.production_skills(store.current(spark, root, "skills")).select("name", "version")


@query("""SELECT 'skill_' || p_size AS name, 'v' || p_partkey AS version, '# ' || p_name AS text FROM part WHERE p_partkey % 5 <> 0""")
def scanned_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill files below a folder, name and version from their names, candidates left out."""
    import os

    folder, key = _folder(spark, "skills"), F.col("p_partkey").cast("string")
    name = F.concat(F.lit("skill_"), F.col("p_size").cast("string"), F.lit("_v"), key, F.when(F.col("p_partkey") % 5 == 0, "_candidate").otherwise(""), F.lit(".md"))
    rows = read(spark, sf_dir, "part").select(name.alias("file"), F.concat(F.lit("# "), "p_name").alias("text"))

    def write(frames):
        from brindle.sources.datasource import file_system

        files, base = file_system(folder)
        files.create_dir(base, recursive=True)
        for pdf in frames:
            for file, content in zip(pdf["file"], pdf["text"], strict=True):
                with files.open_output_stream(os.path.join(base, file)) as stream_:
                    stream_.write(content.encode())
            yield pdf[["file"]]

    rows.mapInPandas(write, "file string").write.format("noop").mode("overwrite").save()
    return skills.scan_skills(spark, folder).select("name", "version", "text")


_EXAMPLES = f"{RUNS}, {REVIEWS}, x AS (SELECT run_id, hgrs, decision, c_name, '{{\"id\":' || run_id || '}}' AS suggestion FROM reviews JOIN runs USING (run_id) JOIN customer ON c_custkey = case_id WHERE status = 'ok' AND hgrs >= 4)"


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_name").alias("case_json"))
    made = runs(spark, sf_dir).withColumn("suggestion_json", F.concat(F.lit('{"id":'), F.col("run_id").cast("string"), F.lit("}")))
    rated = reviews(spark, sf_dir).withColumns({"edited_output_json": F.lit(""), "reviewer_notes": F.lit(None).cast("string")})
    return exporting.examples(rated, made, cases)


@query(f"WITH {_EXAMPLES} SELECT '{INSTRUCTION}' AS instruction, c_name AS input, suggestion AS output, CAST(run_id AS VARCHAR) AS run_id, hgrs FROM x")
def instruction_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = lambda name: F.get_json_object("value", f"$.{name}")
    return exporting.instruction_lines(_examples(spark, sf_dir)).select(field("instruction").alias("instruction"), field("input").alias("input"), field("output").alias("output"), field("meta.run_id").alias("run_id"), field("meta.hgrs").cast("double").alias("hgrs"))


@query(f"WITH {_EXAMPLES} SELECT 'system user assistant' AS roles, c_name AS question, suggestion AS answer, CAST(run_id AS VARCHAR) AS run_id FROM x")
def chat_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = lambda name: F.get_json_object("value", f"$.{name}")
    return exporting.chat_lines(_examples(spark, sf_dir)).select(F.concat_ws(" ", *[field(f"messages[{k}].role") for k in range(3)]).alias("roles"), field("messages[1].content").alias("question"), field("messages[2].content").alias("answer"), field("meta.run_id").alias("run_id"))


@query(f"WITH {_EXAMPLES} SELECT run_id, hgrs, decision, false AS human_edited, '' AS reviewer_notes FROM x")
def review_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exporting.review_table(_examples(spark, sf_dir)).select("run_id", "hgrs", "decision", "human_edited", "reviewer_notes")


_NOTED = f"{REVIEWS}, v AS (SELECT *, l_partkey % 5 AS skill, run_id || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_quantity AS BIGINT) || '-' || CAST(round(l_extendedprice * 100) AS BIGINT) AS review_id FROM reviews)"


def _noted(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = ["run_id", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long"), F.round(F.col("l_extendedprice") * 100).cast("long")]
    rows = reviews(spark, sf_dir).withColumns({"skill": F.col("l_partkey") % 5, "review_id": F.concat_ws("-", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])})
    return rows.withColumn("reviewer_notes", F.concat(F.lit("  note "), "review_id", F.lit(" ")))


@query(f"WITH {_NOTED}, o AS (SELECT skill, CAST(row_number() OVER (PARTITION BY skill ORDER BY hgrs, review_id) AS INTEGER) AS rank, run_id, hgrs, decision, substr('note ' || review_id, 1, 9) AS reviewer_notes FROM v) SELECT * FROM o WHERE rank <= 3")
def lowest_rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.lowest_rated(_noted(spark, sf_dir), ["skill"], chars=9)


@query(f"WITH {_NOTED}, o AS (SELECT skill, CAST(row_number() OVER (PARTITION BY skill ORDER BY review_id) AS INTEGER) AS rank, substr('  note ' || review_id, 1, 12) AS note FROM v) SELECT * FROM o WHERE rank <= 10")
def note_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.note_samples(_noted(spark, sf_dir), ["skill"], chars=12)


@query(f"WITH {RUNS} SELECT agent_mode, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) AS total FROM runs GROUP BY 1")
def ok_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.ok_share(runs(spark, sf_dir))


def _split_documents(spark: SparkSession, sf_dir: str, fraction: float = 0.3) -> DataFrame:
    return splits.split_instances(read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("project")), seed=42, fraction=fraction, key="doc_id", order="doc_id")


_SPLIT = f"b AS (SELECT doc_id, source AS project, {_BUCKET.format('CAST(doc_id AS VARCHAR)')} < 0.3 AS held FROM documents)"


@query(f"WITH {_SPLIT} SELECT CASE WHEN held THEN 'validation' ELSE 'train' END AS split, count(*) AS n FROM b GROUP BY 1")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split_documents(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id = (SELECT min(doc_id) FROM documents) THEN 'validation' ELSE 'train' END AS split FROM documents")
def forced_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split into which no case falls takes the first one."""
    return _split_documents(spark, sf_dir, 0.0).select("doc_id", "split")


@query(f"WITH {_SPLIT}, o AS (SELECT project, doc_id, row_number() OVER (PARTITION BY project ORDER BY doc_id) AS n FROM b WHERE held) SELECT project, doc_id FROM o WHERE n <= 4")
def validation_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _split_documents(spark, sf_dir).withColumns({"smell_id": F.col("doc_id"), "case_id": F.col("doc_id")})
    return analytics.first_cases(cases, 4).select("project", "doc_id")


@query("""SELECT p_partkey, 'org.' || p_size || '|' || 'lib.' || p_partkey AS participants, '{"a":' || p_size || '}' AS unfenced, 'skill_' || p_size AS name, 'v' || p_partkey AS version, 'ARCAN_' || format('{:03d}', p_partkey) AS numbered, 'x|1.5|Y — Z' AS listed FROM part""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Participants in prose, fences, skill file names, numbers and lists in model answers."""
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    named = text.skill_name_version(F.concat(F.lit("s3://b/skills/skill_"), size, F.lit("_v"), key, F.lit(".md")))
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(text.participants(F.concat(F.lit("Cycle among: org."), size, F.lit(", lib."), key, F.lit(", 54."))), "|").alias("participants"),
        text.without_fences(F.concat(F.lit('```json\n{"a":'), size, F.lit("}\n```"))).alias("unfenced"), named["name"].alias("name"), named["version"].alias("version"),
        text.numbered(F.lit("ARCAN_"), F.col("p_partkey")).alias("numbered"), F.array_join(noisy_json.string_list(F.lit('["x", 1.5, {"a": "Y", "b": "Z", "c": 2}]')), "|").alias("listed"),
    )


@query(f"""SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN {' + '.join(str(k) for k in (1, 2, 3, 4, 5, 5))} + CAST(event_id % 5 + 1 AS INTEGER) ELSE 0 END AS total FROM events""")
def critic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores read from a critic's answers: objects or numbers, from 1 to 5, all seven or none."""
    fixed = ['{"score": 1}', '"2"', "3", '{"score": 4.9}', "5", "99"]
    own = F.when(F.col("event_id") % 4 == 0, "null").otherwise((F.col("event_id") % 5 + 1).cast("string"))
    answer = F.concat(F.lit("Scores: {" + ", ".join(f'"{c}": {v}' for c, v in zip(CRITERIA, fixed, strict=False)) + f', "{CRITERIA[-1]}": '), own, F.lit("} done"))
    found = agents.critic_scores(read(spark, sf_dir, "events").select("event_id", answer.alias("answer")))
    total: Column = sum((F.col("scores")[c] for c in CRITERIA), F.lit(0))
    return found.select("event_id", F.coalesce(total, F.lit(0)).alias("total"))


@query("""WITH g AS (SELECT list_sort(list('org.' || p_partkey)) AS c FROM part GROUP BY p_brand, p_size)
SELECT 'scc' || row_number() OVER (ORDER BY c) AS tool_record_id, 'Cyclic Dependency' AS smell_type_raw, array_to_string(c, '|') AS affected_components, CAST(len(c) AS VARCHAR) AS cycle_size FROM g""")
def cycle_smells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smells from a graph in which the parts of each brand and size form a ring, and every ring leads to one component that leads nowhere."""
    part = F.concat(F.lit("org."), F.col("p_partkey").cast("string"))
    groups = read(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.array_sort(F.collect_list(part)).alias("c"))
    rings = groups.select(F.lit("g").alias("graph"), F.posexplode("c").alias("i", "a"), "c").select("graph", "a", F.try_element_at("c", (F.col("i") + 1) % F.size("c") + 1).alias("b"))
    out = groups.select(F.lit("g").alias("graph"), F.col("c")[0].alias("a"), F.lit("org.sink").alias("b"))
    found = graph.cycle_smells(rings.unionByName(out))
    return found.select("tool_record_id", "smell_type_raw", F.array_join("affected_components", "|").alias("affected_components"), F.element_at("attributes", "cycle_size").alias("cycle_size"))


@query(f"WITH {RUNS} SELECT run_id, status FROM runs WHERE status = 'error' AND project = 'p4' ORDER BY created_at DESC, run_id DESC LIMIT 50")
def recent_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report: the latest failed runs of a project."""
    return latest.matching(runs(spark, sf_dir), status="error", project="p4").orderBy(F.col("created_at").desc(), F.col("run_id").desc()).limit(50).select("run_id", "status")
