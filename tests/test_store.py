"""The store, imports, skills, settings and the import stream."""

import json

import pytest
from pyspark.sql import functions as F

from brindle import config
from brindle.functions.vocab import CRITERIA
from brindle.operators.numbering import number_rows
from brindle.sources import imports, reviewing, skills, store
from brindle.streaming import imports as stream

SMELLS = "id,smellType,affectedElements,severity\ns1,Cyclic Dependency,a.pkg;b.pkg,high\n,God Component,c.pkg,\nx,,d.pkg,1\n"
EDGES = "from,to,weight\na.pkg,b.pkg,3\nb.pkg,a.pkg,oops\nb.pkg,,1\n"


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "store")


def test_last_row_wins_and_some_columns_stay(spark, root):
    assert store.current(spark, root, "evidence_cases").count() == 0
    store.append_row(spark, root, "evidence_cases", case_id="c", project="p", case_json="1", split="train")
    store.append_row(spark, root, "evidence_cases", case_id="c", case_json="2")
    store.append_row(spark, root, "evidence_cases", case_id="d", project="q", case_json="3")
    rows = {r.case_id: (r.case_json, r.split) for r in store.current(spark, root, "evidence_cases").collect()}
    assert rows == {"c": ("2", "train"), "d": ("3", None)}
    store.assign(spark.createDataFrame([("c", "validation")], "case_id string, split string"), root)
    assert {r.case_id: r.split for r in store.current(spark, root, "evidence_cases").collect()} == {"c": "validation", "d": None}
    store.clear_cases(spark, root, "p")
    store.clear_cases(spark, root, "p")
    assert [r.case_id for r in store.current(spark, root, "evidence_cases").collect()] == ["d"]


def test_a_removed_key_begins_anew(spark, root):
    store.append_row(spark, root, "evidence_cases", case_id="c", project="p", case_json="1", split="train")
    first = store.current(spark, root, "evidence_cases").first()
    store.append_row(spark, root, "evidence_cases", case_id="c", project="p", case_json="2")
    again = store.current(spark, root, "evidence_cases").first()
    assert again.created_at == first.created_at < again.written_at and (again.case_json, again.split) == ("2", "train")
    store.clear_cases(spark, root, "p")
    store.append_row(spark, root, "evidence_cases", case_id="c", project="p", case_json="3")
    last = store.current(spark, root, "evidence_cases").first()
    assert (last.case_json, last.split) == ("3", None) and last.created_at > first.created_at


def test_reports_are_changed_in_part_and_candidates_promoted(spark, root):
    store.append_row(spark, root, "skills", name="S", version="v0", status="production", text="old")
    store.append_row(spark, root, "skills", name="S", version="v1_candidate", status="candidate", text="new", parent_version="v0")
    report = {"skill_name": "S", "baseline_version": "v0", "candidate_version": "v1_candidate", "report_json": "{}"}
    store.append_row(spark, root, "validation_reports", report_id="bad", passed=False, **report)
    store.append_row(spark, root, "validation_reports", report_id="good", passed=True, **report)
    for unknown in ("bad", "none"):
        with pytest.raises(ValueError, match="no passed report"):
            reviewing.promote(spark, root, unknown, "me")
    assert reviewing.promote(spark, root, "good", "me") == "v1"
    r = store.current(spark, root, "validation_reports").filter("report_id = 'good'").first()
    assert (r.report_json, r.passed, r.human_approved, r.promoted) == ("{}", True, True, True)
    states = {r.version: (r.status, r.text) for r in store.current(spark, root, "skills").collect()}
    assert states == {"v0": ("archived", "old"), "v1_candidate": ("archived", "new"), "v1": ("production", "new")}
    assert [r.actor for r in store.read(spark, root, "audit_log").filter("action = 'promoted'").collect()] == ["me"]


def test_reviews_are_checked_saved_and_changed(spark, root):
    store.append_row(spark, root, "agent_runs", run_id="r1", status="ok")
    good = {c: 4 for c in CRITERIA}
    rows = [("a", "r1", "yes", "accept", good), ("b", "r9", "yes", "accept", good), ("c", "r1", "yes", "accept", good | {CRITERIA[2]: 6}), ("d", "r1", "yes", "burn", good), ("e", "r1", None, "revise", good), ("f", "r1", "no", "revise", good | {CRITERIA[0]: None})]
    schema = "review_id string, run_id string, would_try_it string, decision string, reviewer string, " + ", ".join(f"{c} int" for c in CRITERIA)
    frame = lambda rs: spark.createDataFrame([(*r[:4], "me", *[r[4][c] for c in CRITERIA]) for r in rs], schema)
    refused = {r.review_id: r.problem for r in reviewing.save_reviews(frame(rows), root).collect()}
    assert sorted(refused) == ["b", "c", "d", "e", "f"] and "unknown" in refused["b"] and "score" in refused["c"] and "score" in refused["f"]
    reviewing.save_reviews(frame([("a", "r1", "no", "revise", {c: 5 for c in CRITERIA})]), root)
    assert [(r.review_id, r.hgrs, r.decision) for r in store.current(spark, root, "reviews").collect()] == [("a", 5.0, "revise")]
    assert store.read(spark, root, "audit_log").filter("action = 'saved'").count() == 2


def test_projects_are_added_once(spark, root):
    rows = spark.createDataFrame([("p", "/a"), ("q", "/b")], "project string, path string")
    store.add_projects(rows, root)
    store.add_projects(rows.withColumn("path", F.lit("/other")), root)
    assert sorted((r.project, r.path) for r in store.read(spark, root, "projects").collect()) == [("p", "/a"), ("q", "/b")]


@pytest.mark.parametrize("name", sorted(store.TABLES))
def test_every_table_is_read_where_nothing_was_written(spark, root, name):
    assert store.current(spark, root, name).columns == [c for c in store.schema_of(name).names if c != "removed"] + ["created_at"]


def test_import_builds_cases(spark, root, tmp_path):
    for name, text in (("smells.csv", SMELLS), ("edges.csv", EDGES)):
        (tmp_path / name).write_text(text)
    first = imports.import_file(spark, root, "demo", "arcan", str(tmp_path / "smells.csv"))
    imports.import_file(spark, root, "demo", "static_graph", str(tmp_path / "edges.csv"))
    assert imports.import_file(spark, root, "demo", "arcan", str(tmp_path / "smells.csv")) == first
    assert store.read(spark, root, "raw_findings").groupBy("kind").count().orderBy("kind").collect() == [("edge", 2), ("smell", 2)]
    assert [r.status for r in store.current(spark, root, "tool_runs").collect()] == ["ok", "ok"]
    assert store.read(spark, root, "audit_log").count() == 2
    cases = imports.stored_cases(spark, root, "demo")
    imports.save_cases(cases, root)
    saved = {r.smell_key: json.loads(r.case_json) for r in store.current(spark, root, "evidence_cases").collect()}
    assert sorted(saved) == ["cyclic_dependency", "god_component"]
    assert saved["cyclic_dependency"]["components"] == ["a.pkg", "b.pkg"]
    assert len(saved["cyclic_dependency"]["dependency_evidence"]) == 2


def test_failed_import_is_recorded(spark, root, tmp_path):
    (tmp_path / "x.pdf").write_text("?")
    with pytest.raises(ValueError, match="no reader"):
        imports.import_file(spark, root, "demo", "arcan", str(tmp_path / "x.pdf"))
    assert [(r.status, "no reader" in r.error) for r in store.current(spark, root, "tool_runs").collect()] == [("error", True)]


def test_skills(spark, root, tmp_path):
    folder = tmp_path / "skills"
    folder.mkdir()
    for name in ("BreakCyclicDependencySkill_v0.md", "BreakCyclicDependencySkill_v1.md", "Other.md", "Other_v2_candidate.md"):
        (folder / name).write_text(f"# {name}")
    found = skills.scan_skills(spark, str(folder))
    assert sorted((r.name, r.version) for r in found.collect()) == [("BreakCyclicDependencySkill", "v0"), ("BreakCyclicDependencySkill", "v1"), ("Other", "v0")]
    fresh = skills.new_skills(found, store.current(spark, root, "skills"))
    store.append(fresh, root, "skills")
    assert skills.new_skills(found, store.current(spark, root, "skills")).count() == 0
    live = {r.name: r.version for r in skills.production_skills(store.current(spark, root, "skills")).collect()}
    assert live == {"BreakCyclicDependencySkill": "v0", "Other": "v0"}
    cases = spark.createDataFrame([("c", "cyclic_dependency"), ("d", "god_component")], "case_id string, smell_key string")
    got = {r.case_id: r.skill_version for r in skills.with_skill(cases, store.current(spark, root, "skills")).collect()}
    assert got == {"c": "v0", "d": None}


def test_revised_skills(spark):
    rows = [("S", "v3", "```markdown\n# S " + "x" * 300 + "\n```"), ("T", "v0", "too short")]
    got = skills.revised(spark.createDataFrame(rows, "name string, version string, answer string")).collect()
    assert [(r.version, r.parent_version, r.text.startswith("# S"), r.text.endswith("x")) for r in got] == [("v4_candidate", "v3", True, True)]


def test_settings():
    got = config.load({"seed": 5}, {"BRINDLE_SEED": "7", "BRINDLE_CRITIC": "yes", "BRINDLE_LEAST_GAIN": "0.2", "BRINDLE_STORE": ""})
    assert (got.seed, got.critic, got.least_gain, got.store) == (7, True, 0.2, "store")
    with pytest.raises(ValueError, match="weights"):
        config.load({"weights": {"evidence_grounding": "1"}}, {})
    with pytest.raises(TypeError):
        config.load({"no_such": 1}, {})


def test_settings_from_a_file(tmp_path):
    (tmp_path / "s.json").write_text('{"seed": 3, "critic": true}')
    got = config.load_file(str(tmp_path / "s.json"), {"BRINDLE_SEED": "4"})
    assert (got.seed, got.critic) == (4, True)


def test_stream_imports_each_content_once(spark, root, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    text = json.dumps({"smells": [{"smellType": "God Component", "affectedElements": ["a"]}, "no object"]})
    (folder / "a.json").write_text(text)
    run = lambda: stream.import_stream(spark, str(folder), root, "p", "arcan", str(tmp_path / "checkpoint")).awaitTermination(120)
    run()
    (folder / "b.json").write_text(text)
    (folder / "c.json").write_text(json.dumps([{"smellType": "Cyclic Dependency"}, {"smellType": "x"}]))
    run()
    assert store.read(spark, root, "raw_findings").count() == 3
    assert store.current(spark, root, "tool_runs").filter("status = 'ok'").count() == 2


def test_streamed_smells_become_cases_also_when_a_batch_comes_twice(spark, root, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    doc = {"smells": [{"smellType": "Cyclic Dependency", "affectedElements": "ui;db", "severity": "high"}], "edges": [{"from": "ui", "to": "db", "weight": 2}, {"from": "db", "to": "ui", "weight": "many"}]}
    (folder / "a.json").write_text(json.dumps(doc))
    for k in range(2):  # the second checkpoint knows nothing of the first, as after a failure before its commit
        stream.import_stream(spark, str(folder), root, "p", "arcan", str(tmp_path / f"checkpoint{k}")).awaitTermination(120)
    (case,) = imports.stored_cases(spark, root, "p").collect()
    assert (case.smell_key, case.components) == ("cyclic_dependency", ["db", "ui"])
    assert [f.tool for f in case.tool_findings] == ["arcan"]
    assert sorted((e.from_component, e.to_component) for e in case.dependency_evidence) == [("db", "ui"), ("ui", "db")]
    assert store.current(spark, root, "graph_edges").count() == 2


def test_projects_do_not_disturb_each_other(spark, root):
    for project in ("p", "q"):
        for n in range(3):
            store.append_row(spark, root, "evidence_cases", case_id=f"{project}{n}", project=project, case_json="1", split="train")
            store.append_row(spark, root, "evidence_cases", case_id=f"{project}{n}", project=project, case_json="2")
    files = lambda project: sorted(f for f in store.read(spark, root, "evidence_cases").filter(F.col("project") == project).inputFiles() if f"project={project}" in f)
    before, others = store.current(spark, root, "evidence_cases").orderBy("case_id").collect(), files("q")
    store.compact(spark, root, "evidence_cases", "p")
    assert store.current(spark, root, "evidence_cases").orderBy("case_id").collect() == before
    assert len(store.read(spark, root, "evidence_cases").filter("project = 'p'").collect()) == 3 and files("q") == others
    store.append_row(spark, root, "evidence_cases", case_id="p1", project="p", split="validation")
    store.clear_cases(spark, root, "p")
    store.append_row(spark, root, "evidence_cases", case_id="p2", project="p", case_json="3")
    assert [(r.case_id, r.case_json, r.split) for r in store.current(spark, root, "evidence_cases", "p").collect()] == [("p2", "3", None)]
    assert store.current(spark, root, "evidence_cases", "q").count() == 3 and files("q") == others
    with pytest.raises(ValueError, match="no partitions"):
        store.compact(spark, root, "reviews", "p")


def test_only_a_projects_partitions_are_read(spark, root, capsys):
    for project in ("p", "q"):
        store.append_row(spark, root, "graph_edges", run_id="r", project=project, evidence_id="E", from_component="a", to_component="b")
    store.current(spark, root, "graph_edges", "p").explain("formatted")
    plan = capsys.readouterr().out
    filters = [line for line in plan.splitlines() if "PartitionFilters" in line]
    assert filters and all("project" in line and "= p" in line for line in filters)
    store.append_row(spark, root, "graph_edges", run_id="r", project="s", evidence_id="E", from_component="a", to_component="b")
    several = store.current(spark, root, "graph_edges", ["p", "s"])
    assert sorted(r.project for r in several.collect()) == ["p", "s"]
    several.explain("formatted")
    filters = [line for line in capsys.readouterr().out.splitlines() if "PartitionFilters" in line]
    assert filters and all("project" in line and "IN (p,s)" in line for line in filters)


def test_projects_are_named_while_they_are_few(spark, monkeypatch):
    frame = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "project string")
    assert sorted(store.projects_of(frame)) == ["a", "b"]
    assert store.projects_of(frame.limit(0)) == []
    monkeypatch.setattr(store, "NAMED_PROJECTS", 1)
    assert store.projects_of(frame) is None


@pytest.mark.parametrize("partitions", [1, 7])
def test_numbers_go_on_over_ranges(spark, partitions):
    rows = [((i * 7919) % 1000, f"x{i}") for i in range(1000)]
    frame = spark.createDataFrame(rows, "k int, v string").repartition(partitions)
    got = number_rows(frame, [F.col("k")]).collect()
    assert sorted((r.n, r.k) for r in got) == [(i + 1, i) for i in range(1000)]
    assert number_rows(frame.limit(0), [F.col("k")]).count() == 0


def test_edges_are_numbered_on_from_the_last_import(spark, root, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for n in range(3):
        (folder / f"{n}.csv").write_text(f"from{';,'[n % 2]}to\na{n}{';,'[n % 2]}b\nb{';,'[n % 2]}a{n}\n")
    imports.import_file(spark, root, "demo", "static_graph", f"{folder}/*.csv")
    imports.import_file(spark, root, "other", "static_graph", f"{folder}/*.csv")
    (folder / "2.csv").write_text("from,to\nx,y\n")
    imports.import_file(spark, root, "demo", "static_graph", f"{folder}/*.csv")
    got = sorted((r.evidence_id, r.from_component) for r in store.current(spark, root, "graph_edges", "demo").collect())
    assert [e for e, _ in got] == [f"STATIC_GRAPH_EDGE_{n:03d}" for n in range(1, 12)]
    assert [f for _, f in got][:6] == ["a0", "b", "a1", "b", "a2", "b"] and got[-1][1] == "x"
    assert imports.last_edge(spark, root, "demo") == 11 and imports.last_edge(spark, root, "other") == 6


def test_a_fold_shuffles_rows_once_as_they_are(spark, tmp_path):
    root = str(tmp_path)
    store.append(spark.range(5).selectExpr("CAST(id AS string) AS run_id", "'p' AS project", "'ok' AS status"), root, "agent_runs")
    store.append(spark.range(5).filter("id > 2").selectExpr("CAST(id AS string) AS run_id", "'p' AS project", "true AS removed"), root, "agent_runs")
    store.append(spark.range(5).filter("id % 2 = 0").selectExpr("CAST(id AS string) AS run_id", "'p' AS project", "'{}' AS checks_json"), root, "agent_runs")
    found = store.current(spark, root, "agent_runs", "p")
    plan = found._jdf.queryExecution().executedPlan().toString()  # before it is run, which adds the final one
    assert sorted((r.run_id, r.status, r.checks_json) for r in found.collect()) == [("0", "ok", "{}"), ("1", "ok", None), ("2", "ok", "{}"), ("4", None, "{}")]
    assert plan.count("Exchange hashpartitioning") == 1 and "Aggregate" not in plan and "Join" not in plan


def test_rows_are_numbered_within_groups_of_any_size(spark):
    rows = spark.range(1000).selectExpr("CASE WHEN id % 10 = 0 THEN NULL WHEN id % 10 = 1 THEN 'b' ELSE 'a' END AS g", "(id * 7) % 1000 AS k")
    found = number_rows(rows, [F.col("k")], by=("g",))
    got = {}
    for r in found.orderBy("k").collect():
        got.setdefault(r.g, []).append(r.n)
    assert {g: len(n) for g, n in got.items()} == {None: 100, "a": 800, "b": 100} and all(n == list(range(1, len(n) + 1)) for n in got.values())
    plan = number_rows(rows, [F.col("k")], by=("g",)).select("n")._jdf.queryExecution().executedPlan().toString()
    assert "row_number" not in plan


def test_cases_are_numbered_by_ranges_and_pairs_are_made_after_the_shuffle(spark):
    from brindle.operators import normalize

    smells = spark.range(9).selectExpr("'p' AS project", "CAST(id AS string) AS seq", "'arcan' AS tool", "'x' AS tool_record_id", "'f' AS source_file", "'Cyclic Dependency' AS smell_type_raw", "array('a', 'b' || id) AS affected_components", "map('k', 'v') AS attributes")
    cases = normalize.group_findings(smells)
    assert [r.seq for r in cases.orderBy("components").collect()] == list(range(1, 10))
    assert "row_number" not in cases._jdf.queryExecution().executedPlan().toString()
    inside = spark.createDataFrame([("c", "a", "b")], "case_id string, from_component string, to_component string")
    one = spark.createDataFrame([("c", ["a", "b", "d"])], "case_id string, components array<string>")
    pairs = normalize.uncovered_pairs(one, inside)
    assert sorted((r.a, r.b) for r in pairs.collect()) == [("a", "d"), ("b", "d"), ("d", "a"), ("d", "b")]
    top = pairs._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    assert "Generate" in top  # the pairs are made above all joins


def test_rings_that_share_a_sink_are_searched_apart(spark, monkeypatch):
    from brindle.operators import graph

    def never(edges):
        raise AssertionError("rings were coloured step by step")

    monkeypatch.setattr(graph, "TASK_EDGES", 40)
    monkeypatch.setattr(graph, "_coloured", never)
    rings = [("g", f"{r}.{k}", f"{r}.{(k + 1) % 10}") for r in range(5) for k in range(10)]
    edges = spark.createDataFrame([*rings, *[("g", f"{r}.0", "sink") for r in range(5)], ("h", "x", "x")], "graph string, a string, b string")
    found = sorted((r.graph, r.n, r.size, r.members[0]) for r in graph.cycles(edges).collect())
    assert found == [*[("g", r + 1, 10, f"{r}.0") for r in range(5)], ("h", 1, 1, "x")]


def test_supplier_cycles_of_light_edges_are_found(spark, tmp_path):
    from brindle.plans import catalogue

    ends = [(1, 2)] * 60 + [(3, 4), (4, 5), (5, 3), (5, 6)]
    lines = [(n, at, s) for n, e in enumerate(ends) for at, s in enumerate(e, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = catalogue.queries()["scc_cycles"](spark, str(tmp_path)).collect()
    assert [tuple(r) for r in found] == [(1, "3|4|5", 3)]


def test_long_rings_are_parts_after_a_few_rounds(spark, monkeypatch):
    from brindle.operators import graph

    made, rounds = graph.written, []
    monkeypatch.setattr(graph, "TASK_EDGES", 300)
    monkeypatch.setattr(graph, "written", lambda df, name: (rounds.append(name), made(df, name))[1])
    # rings in order of name, in which the least name would need a step for each member
    rings = [("g", r * 1000 + k, r * 1000 + (k + 1) % 250) for r in range(8) for k in range(250)]
    edges = spark.createDataFrame([*rings, *[("g", r * 1000, 9999) for r in range(8)]], "graph string, a long, b long")
    found = sorted((r.n, r.size, r.members[0], r.members[-1]) for r in graph.cycles(edges).collect())
    assert found == [(r + 1, 250, r * 1000, r * 1000 + 249) for r in range(8)]
    assert len(rounds) < 25 and 0 < rounds.count("scc-merged") < 9 and "Broadcast" not in plan_of_cycles(edges)


def plan_of_cycles(edges):
    from brindle.operators import graph

    return graph._in_parts(edges)._jdf.queryExecution().executedPlan().toString()


def test_an_import_reads_its_edges_once(spark, tmp_path, monkeypatch):
    root, seen = str(tmp_path / "store"), tmp_path / "seen"
    seen.mkdir()
    (tmp_path / "edges.csv").write_text("from,to\n" + "".join(f"a{n},b{n}\n" for n in range(50)))

    def counted(frames, folder=str(seen)):
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        yield from frames

    real = imports.read_export

    def read(*args):
        parts = real(*args)
        return parts | {"edges": parts["edges"].mapInPandas(counted, parts["edges"].schema)}

    monkeypatch.setattr(imports, "read_export", read)
    imports.import_file(spark, root, "demo", "static_graph", str(tmp_path / "edges.csv"))
    assert len(list(seen.iterdir())) == 1
    assert store.current(spark, root, "graph_edges", "demo").count() == store.current(spark, root, "raw_findings", "demo").count() == 50


def test_a_stream_reads_what_arrived_once(spark, tmp_path, monkeypatch):
    from brindle.streaming import imports as stream

    made, names = stream.written, []
    monkeypatch.setattr(stream, "written", lambda df, name: (names.append((name, df)), made(df, name))[1])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"edges": [{"from": "a", "to": "b"}, {"from": "b", "to": "a"}]}')
    root = str(tmp_path / "store")
    stream.import_stream(spark, str(tmp_path / "in"), root, "p", "arcan", str(tmp_path / "checkpoint")).awaitTermination()
    names = [name for name, _ in names]  # a batch without files may follow
    assert names[:2] == ["arrived", "arrived-edges"] and names.count("arrived") == names.count("arrived-edges") == len(names) / 2
    assert store.current(spark, root, "graph_edges", "p").count() == 2 and store.current(spark, root, "raw_findings", "p").count() == 2


def test_refused_reviews_can_be_dropped_once_read(spark, tmp_path):
    from pathlib import Path

    from brindle.plans import catalogue
    from brindle.session import shared_folder

    before = {p.name for p in Path(shared_folder(spark)).iterdir()}
    catalogue.queries()["saved_reviews"](spark, "/root/testdata/sf0.001").count()
    left = {p.name.rpartition("-")[0] for p in Path(shared_folder(spark)).iterdir() if p.name not in before and any(p.rglob("*.parquet"))} - {""}
    assert left == set()


def test_a_table_without_files_needs_no_python(spark, tmp_path):
    none = store.read(spark, str(tmp_path / "nothing"), "tool_runs")
    assert none.count() == 0 and none.columns[-1] == "first_at" and "RDD" not in none._jdf.queryExecution().executedPlan().toString()
