"""Readers over small files of each kind."""

import csv
import hashlib
import io
import json
import tempfile
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.operators import graph, latest, normalize
from brindle.sources import datasource, exports, slicing


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_smell_csv(spark, tmp_path):
    path = write(tmp_path, "s.csv", "ID,SmellType,AffectedElements,Severity,Size,ATDI\n1,Cyclic Dependency,a.pkg;b.pkg,high,2,1.5\n2,God Component,c.pkg,,,\n")
    out = exports.read_smell_file(spark, path)
    got = out["smells"].orderBy("row_no").collect()
    assert [r["affected_components"] for r in got] == [["a.pkg", "b.pkg"], ["c.pkg"]]
    assert got[0]["attributes"]["severity"] == "high" and "atdi" in got[0]["attributes"] and "Severity" not in got[1]["attributes"]
    assert out["edges"].count() == out["metrics"].count() == 0


def test_bracketed_list_and_vertex_id(spark, tmp_path):
    path = write(tmp_path, "r.csv", 'project,versionId,ATDI,AffectedElements,Severity,Size,smellType,vertexId\np,1,2.5,"[org.a, \'org.b\', org.a]",3,2,cyclicDep,v7\n')
    r = exports.read_smell_file(spark, path)["smells"].first()
    assert r["affected_components"] == ["org.a", "org.b"] and r["tool_record_id"] == "v7"


def test_edge_csv_with_bom_and_semicolons(spark, tmp_path):
    path = write(tmp_path, "e.csv", "﻿Source;Target;Weight\na;b;4\nb;;2\nc;d;many\n")
    out = exports.read_smell_file(spark, path)
    assert rows(out["edges"].na.fill(-1.0), "from_component", "to_component", "weight") == [("a", "b", 4.0), ("c", "d", -1.0)]


def test_metric_csv_becomes_long(spark, tmp_path):
    path = write(tmp_path, "m.csv", "project,FanIn,FanOut,InstabilityMetric,LinesOfCode,name,vertexLabel\np,1,2,,400,org.a,package\n")
    assert rows(exports.read_smell_file(spark, path)["metrics"], "component", "name", "value") == [("org.a", "FanIn", "1"), ("org.a", "FanOut", "2"), ("org.a", "LinesOfCode", "400")]


def test_empty_file_and_header_only(spark, tmp_path):
    out = exports.read_smell_file(spark, write(tmp_path, "h.csv", "ID,SmellType,AffectedElements\n"))
    assert all(df.count() == 0 for df in out.values())


def test_prose_participants(spark, tmp_path):
    text = 'Project,Package,Smell,Description\np,shop.cart,Cyclic Dependency,"A loop between: shop.cart, shop.price, 12."\np,shop.ship,God Component,"Too much with: 12, shop.price"\n'
    got = exports.read_prose_smells(spark, write(tmp_path, "d.csv", text))["smells"].orderBy("row_no").collect()
    assert [r["affected_components"] for r in got] == [["shop.cart", "shop.price"], ["shop.ship"]]


def test_class_level_component(spark, tmp_path):
    got = exports.read_prose_smells(spark, write(tmp_path, "c.csv", "Project,Package,Class,Method,Smell,Description\np,shop.cart,Basket,,God Class,x\np,shop.cart,Basket,add,Long Method,y\n"))["smells"].orderBy("row_no").collect()
    assert [r["affected_components"] for r in got] == [["shop.cart.Basket"], ["shop.cart.Basket::add"]]


@pytest.mark.parametrize("name, text", [("g.csv", "from,to\nui,api\napi,db\ndb,api\napi,log\n"), ("g.json", json.dumps({"ui": "api", "api": ["db", "log"], "db": ["api"]})), ("g.dot", 'digraph { ui -> "api"; api -> db\n db -> api; "api" -> "log" }'), ("h.json", json.dumps({"edges": [{"from": x, "to": y, "weight": 2} for x, y in (("ui", "api"), ("api", "db"), ("db", "api"), ("api", "log"))]}))])
def test_graph_files_and_cycles(spark, tmp_path, name, text):
    edges = exports.read_graph_file(spark, write(tmp_path, name, text))
    assert rows(edges, "from_component", "to_component") == [("api", "db"), ("api", "log"), ("db", "api"), ("ui", "api")]
    found = graph.cycle_smells(edges.select(edges.source_file.alias("graph"), edges.from_component.alias("a"), edges.to_component.alias("b"))).collect()
    assert [r["affected_components"] for r in found] == [["api", "db"]] and found[0]["attributes"]["cycle_size"] == "2"


def brute_components(edges):
    """Vertices that reach each other, by closing the relation."""
    names = {v for e in edges for v in e}
    reach = {v: {b for a, b in edges if a == v} for v in names}
    while any((more := set().union(*[reach[w] for w in reach[v]], reach[v])) != reach[v] and not reach.__setitem__(v, more) for v in names):
        pass
    return sorted((v, min([w for w in names if v in reach[w] and w in reach[v]] + [v])) for v in names)


@pytest.mark.parametrize("at_once", [200_000, 12, 0])
def test_components_whole_in_parts_and_coloured(spark, monkeypatch, at_once):
    """The same components whether a graph fits a task, only its parts do, or nothing does."""
    monkeypatch.setattr(graph, "TASK_EDGES", at_once)
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("x", "y"), ("y", "z"), ("z", "y"), ("s", "s"), ("k", "l")]
    frame = spark.createDataFrame([("g", a, b) for a, b in edges] + [("g", "a", "b"), ("g", None, "a"), ("h", "p", "q"), ("h", "q", "p")], "graph string, a string, b string")
    got = graph.strong_components(frame).collect()
    assert sorted((r.v, r.component) for r in got if r.graph == "g") == brute_components(edges)
    assert sorted((r.v, r.component) for r in got if r.graph == "h") == [("p", "p"), ("q", "p")]


def test_long_falling_chain(spark):
    """2,000 vertices in a row, and a ring at its end."""
    edges = [(i, i + 1) for i in range(2000)] + [(2000, 1990)]
    frame = spark.createDataFrame([("g", a, b) for a, b in edges], "graph string, a int, b int")
    began = time.perf_counter()
    sizes = graph.strong_components(frame).groupBy("component").count().filter("count > 1").collect()
    assert [(r.component, r["count"]) for r in sizes] == [(1990, 11)]
    assert time.perf_counter() - began < 60


def test_self_loop_is_a_cycle_and_chains_are_none(spark):
    edges = spark.createDataFrame([("g", "a", "a"), ("g", "b", "c"), ("h", "x", "y"), ("h", "y", "x")], "graph string, a string, b string")
    assert [(r["graph"], r["members"]) for r in graph.cycles(edges).orderBy("graph").collect()] == [("g", ["a"]), ("h", ["x", "y"])]
    assert graph.cycles(edges.limit(0)).count() == 0


def test_smell_json(spark, tmp_path):
    doc = {"smells": [{"id": "s1", "smellType": "Hub-Like", "affectedElements": "a;b", "n": 3}, "junk", {"id": 2}], "edges": [{"from": "a", "to": "b", "weight": 1.5}, {"from": "a"}]}
    out = exports.read_smell_json(spark, write(tmp_path, "s.json", json.dumps(doc)))
    r = out["smells"].collect()
    assert len(r) == 1 and r[0]["affected_components"] == ["a", "b"] and r[0]["attributes"]["n"] == "3"
    assert rows(out["edges"], "from_component", "to_component", "weight") == [("a", "b", 1.5)]


def test_three_tools_make_one_case(spark, tmp_path):
    smells = spark.createDataFrame(
        [("p", 1, "arcan", "1", "f", "Cyclic Dependency", ["b.pkg", "a.pkg"], {"Severity": "high", "tool": "x"}), ("p", 2, "designite", "row1", "g", "cyclic-dep cycle", ["a.pkg", "b.pkg", "a.pkg"], {}), ("p", 3, "static_graph", "scc1", "h", "Cyclic Dependency", ["a.pkg", "b.pkg"], {"cycle_size": "2"}), ("p", 4, "arcan", "9", "f", "God Component", [], {})],
        "project string, seq long, tool string, tool_record_id string, source_file string, smell_type_raw string, affected_components array<string>, attributes map<string,string>",
    )
    edges = spark.createDataFrame([("p", "a.pkg", "b.pkg", "E1", "depends", 1.0, "arcan"), ("p", "a.pkg", "z", "E2", "depends", 1.0, "arcan")], "project string, from_component string, to_component string, evidence_id string, relation_type string, confidence double, source string")
    metrics = spark.createDataFrame([("p", "a.pkg", "FanIn", "3", "arcan")], "project string, component string, name string, value string, tool string")
    case = normalize.build_cases(smells, edges, metrics).collect()
    assert len(case) == 1
    case = case[0]
    assert case["smell_id"] == "ARCAN_CD_001" and case["components"] == ["a.pkg", "b.pkg"] and case["limitations"] is None
    assert [f["evidence_id"] for f in case["tool_findings"]] == ["ARCAN_CD_001", "DESIGNITE_CD_001_2", "STATIC_GRAPH_CD_001_3"]
    assert [e["evidence_id"] for e in case["dependency_evidence"]] == ["E1"]
    assert {m["evidence_id"] for m in case["metrics"]} == {"ARCAN_CD_001_M_SEVERITY", "STATIC_GRAPH_CD_001_3_M_CYCLE_SIZE", "ARCAN_CD_001_CM_01"}


def test_limitations_without_edges(spark):
    smells = spark.createDataFrame([("p", 1, "arcan", "1", "f", "cycle", ["a", "b"], {})], "project string, seq long, tool string, tool_record_id string, source_file string, smell_type_raw string, affected_components array<string>, attributes map<string,string>")
    edges = spark.createDataFrame([], "project string, from_component string, to_component string, evidence_id string, relation_type string, confidence double, source string")
    metrics = spark.createDataFrame([], "project string, component string, name string, value string, tool string")
    found = normalize.build_cases(smells, edges, metrics).first()["limitations"]
    assert len(found) == 2 and "a <-> b, b <-> a" in found[0]


def test_readers_and_categories_can_be_added(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(exports.READERS, "mine", (("log",), lambda spark, path, tool: {"smells": spark.range(2)}))
    assert exports.read_export(spark, "x.LOG", "mine")["smells"].count() == 2
    for path, tool in (("x.csv", "mine"), ("x.csv", "other")):
        with pytest.raises(ValueError, match="no reader"):
            exports.read_export(spark, path, tool)
    taxonomy = (("big_ball", "Big Ball", "BB", ("mud",)),)
    smells = spark.createDataFrame([("p", "1", "t", "r", "f", "A ball of mud", ["a"], {"k": "v"})], "project string, seq string, tool string, tool_record_id string, source_file string, smell_type_raw string, affected_components array<string>, attributes map<string,string>")
    assert [(r.smell_key, r.smell_id) for r in normalize.group_findings(smells, taxonomy).collect()] == [("big_ball", "T_BB_001")]


def test_null_is_a_value_of_a_facet(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "n int, actor string")
    assert [r.n for r in latest.matching(rows, actor=["a", None]).orderBy("n").collect()] == [1, 2]
    assert latest.matching(rows, actor=None).count() == 3


def test_each_file_is_a_partition_with_its_own_delimiter_and_kind(spark, tmp_path):
    for n in range(200):
        text = ["id,smellType,affectedElements\n1,Cycle,a;b\n\n2,God Class,c\n", "from;to;weight\na;b;1\n", "name\tFanIn\norg.a\t7\n"][n % 3]
        (tmp_path / f"{n:03d}.csv").write_text(text)
    rows = exports.read_rows(spark, f"{tmp_path}/*.csv")
    assert rows.rdd.getNumPartitions() == 200
    out = exports.read_export(spark, f"{tmp_path}/*.csv", "arcan")
    assert {k: df.count() for k, df in out.items()} == {"smells": 134, "edges": 67, "metrics": 66}
    assert sorted({(r.row_no, r.smell_type_raw) for r in out["smells"].collect()}) == [(1, "Cycle"), (2, "God Class")]
    few = spark.read.format("brindle_export").option("filesPerPartition", "64").load(str(tmp_path))
    assert few.rdd.getNumPartitions() == 4 and few.count() == rows.count()
    with pytest.raises(Exception, match="FileNotFound|nothing_here"):
        exports.read_rows(spark, f"{tmp_path}/nothing_here/*.csv").count()


def _rows_of(path, size, spark):
    files = [(p, n) for _, p, n in datasource.listed_files(path)]
    slices = slicing.cut_files(spark, files, size)
    return slices, [tuple(r) for r in exports.read_rows(spark, path, slices=slices).select("row_no", "kind", "fields").orderBy("row_no").collect()]


#: Line ends inside quotes, quotes inside fields and doubled ones, empty lines, every kind of line end, a row without an end.
TRICKY = [
    'id,smellType,affectedElements\n' + "".join(f'{k},"God\n{"x" * (k % 9)}\n\nClass",a;b{k}\n' + "\n" * (k % 3) for k in range(60)),
    '\ufeffid,smellType,affectedElements\r\n' + "".join(f'{k},Hub "{k}" of,"he said ""{k}"", twice\r\n{k}"\r\n\r\n' for k in range(60)),
    'id,smellType\n' + "".join(f"{k},é{'ü' * (k % 5)}\r{k}b,mid\n" for k in range(60)),
    'id,smellType\n1,"' + "all quoted,\n" * 80 + '"\n2,last',
    'id,smellType\n1,x\n2,"never closed\n' + "a,b\n" * 50,
    '"id\nover lines",smellType\n' + "".join(f'{k},"a""\n"\n' for k in range(40)),
    "\n\n" + "1,2\n" * 30,
    "id,smellType\r" + "1,x\r2,y\r" * 20,
]


@pytest.mark.parametrize("text", TRICKY)
def test_slices_give_the_rows_of_the_whole_file(spark, tmp_path, text):
    (tmp_path / "a.csv").write_bytes(text.encode())
    none, whole = _rows_of(str(tmp_path / "a.csv"), 1 << 20, spark)
    plain = csv.reader(io.StringIO(text.removeprefix("\ufeff"), newline=""))
    next(plain)
    assert none == [] and len(whole) == sum(1 for line in plain if line)
    size = len(text.encode())
    for n in (3, 17):
        slices, got = _rows_of(str(tmp_path / "a.csv"), -(-size // n), spark)
        assert got == whole
        assert (slices[0].start, slices[-1].stop) == (0, size) and all(a.stop == b.start for a, b in zip(slices, slices[1:], strict=False))


@given(st.lists(st.sampled_from(['"', ",", "\n", "\r\n", "\r", "a", "é", '""', '"\n', 'x,"']), max_size=60), st.integers(1, 40))
@settings(max_examples=150, deadline=None)
def test_any_text_is_cut_without_a_change(parts, size):
    """What readers of slices see, against one reader of the whole text; no Spark."""
    text = "".join(parts).encode()
    with tempfile.NamedTemporaryFile(suffix=".csv") as file:
        file.write(text)
        file.flush()
        want, got, within, before = list(slicing.Rows(file.name, ",")), [], False, 0
        for path, start, stop in slicing.ranges([(file.name, len(text))], size):
            low, high, n, ends = slicing.told(path, ",", start, stop)
            if low < high:
                rows = list(slicing.Rows(path, ",", low, high, within))
                got += rows[1:] if within else rows
                assert n[within] == sum(1 for row in (rows[1:] if within or low == 0 else rows) if row)
            within, before = ends[within], before + n[within]
    assert got == want


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    (tmp_path / "big.csv").write_text("id,smellType,affectedElements\n" + "".join(f's{k},"Cyclic\nDependency",a{k};b\n' for k in range(5000)))
    (tmp_path / "small.csv").write_text("id,smellType,affectedElements\ns,God Class,c\n")
    whole = exports.read_export(spark, f"{tmp_path}/*.csv", "arcan")["smells"]
    cut = exports.read_smell_file(spark, f"{tmp_path}/*.csv", slice_bytes=20_000)["smells"]
    assert cut.rdd.getNumPartitions() >= 9
    columns = ("source_file", "row_no", "tool_record_id", "smell_type_raw")
    assert rows(cut, *columns) == rows(whole, *columns) and cut.count() == 5001
    files = [(p, n) for _, p, n in datasource.listed_files(f"{tmp_path}/*.csv")]
    assert slicing.file_hashes(spark, files, 1 << 30)[files[1][0]] == hashlib.sha256((tmp_path / "small.csv").read_bytes()).hexdigest()
    assert slicing.file_hashes(spark, files, 20_000)[files[0][0]] != slicing.file_hashes(spark, files)[files[0][0]]


def test_files_that_arrive_are_streamed_once(spark, tmp_path):
    datasource.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()

    def run():
        stream = spark.readStream.format("brindle_export").load(str(folder))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        return sorted((r.source_file, r.row_no) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    (folder / "a.csv").write_text("from,to\na,b\nb,a\n")
    assert run() == [("a.csv", 1), ("a.csv", 2)]
    time.sleep(0.05)
    (folder / "b.json").write_text(json.dumps({"edges": [{"from": "x", "to": "y"}]}))
    assert run() == run() == [("a.csv", 1), ("a.csv", 2), ("b.json", 1)]


def test_loose_json(spark, tmp_path):
    edges = [{"from": "a", "to": "b", "weight": w} for w in (2, 1.5, "3", "many", None, True, [1], {"n": 1})] + ["a", 3, None, {"from": "", "to": "b"}, {"from": 7, "to": 8.5}]
    smells = [{"type": "Hub", "affectedElements": ["a", 1, None, {"x": 2}], "size": 3, "note": None, "deep": {"k": [1]}}, {"smellType": "", "smell_type": "God", "affected_components": "x;y"}, ["no object"], {"smellType": None}, {"smellType": 5, "id": 9}]
    out = exports.read_smell_json(spark, write(tmp_path, "s.json", json.dumps({"smells": smells, "edges": edges})))
    got = out["edges"].orderBy("row_no").collect()
    assert [r.weight for r in got] == [2.0, 1.5, 3.0, None, None, None, None, None, None]
    assert [r.weight_json for r in got] == ["2", "1.5", '"3"', '"many"', None, "true", "[1]", '{"n":1}', None]
    assert [(r.from_component, r.to_component) for r in got][-1] == ("7", "8.5")
    found = out["smells"].orderBy("row_no").collect()
    assert [(r.smell_type_raw, r.affected_components, r.tool_record_id) for r in found] == [("Hub", ["a", "1", None, '{"x":2}'], "json1"), ("God", ["x", "y"], "json2"), ("5", [], "9")]
    assert found[0].attributes["size"] == "3" and found[0].attributes["note"] is None and found[0].attributes["deep"] == '{"k":[1]}'
    graph_edges = exports.read_graph_file(spark, write(tmp_path, "g.json", json.dumps({"a": ["b", 3, None], "c": "d", "e": [], "f": None})))
    assert rows(graph_edges, "from_component", "to_component") == [("a", "3"), ("a", "b"), ("c", "d")]


def test_streamed_documents_read_as_files_do(spark, tmp_path):
    doc = {"smells": [{"type": "Hub", "affectedElements": ["a", 1]}, 7], "edges": [{"from": "a", "to": "b", "weight": "x"}]}
    text = spark.createDataFrame([(json.dumps(doc), "s.json"), ("broken", "t.json"), (json.dumps(doc["smells"]), "u.json")], "text string, source_file string")
    whole = exports.read_smell_json(spark, write(tmp_path, "s.json", json.dumps(doc)))
    assert exports.smells_of(text.limit(1), "arcan").collect() == whole["smells"].collect()
    assert exports.edges_of(text, "arcan").collect() == whole["edges"].collect()
    assert exports.smells_of(text, "arcan").count() == 2


def test_many_small_files_share_tasks():
    from brindle.sources.datasource import ALONE, OPENING, TASK_BYTES, packed

    few, many = [(str(n), 10) for n in range(ALONE)], [(str(n), 4000) for n in range(100_000)]
    assert packed(few) == [[x] for x, _ in few]
    lists = packed(many)
    assert [x for part in lists for x in part] == [x for x, _ in many]
    assert len(lists) < 1000 and max(map(len, lists)) * (4000 + OPENING) <= TASK_BYTES
    large = packed([(str(n), 2 * TASK_BYTES) for n in range(ALONE + 1)])
    assert len(large) == ALONE + 1
