"""Scalar functions, scores, splits and exports on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from brindle.functions import noisy_json, text
from brindle.functions.vocab import CRITERIA, WEIGHTS
from brindle.operators import analytics, exporting, latest, scoring, splits


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("listed, want", [("a;b;a", ["a", "b"]), ("[x, 'y' , \"z\"]", ["x", "y", "z"]), ("a|b,c", ["a", "b,c"]), ("", []), (None, []), (" one ", ["one"]), ("a;;b;", ["a", "b"])])
def test_split_components(spark, listed, want):
    assert value(spark, text.split_components(F.lit(listed).cast("string"))) == want


@pytest.mark.parametrize(
    "label, key, code",
    [("Cyclic Dependency", "cyclic_dependency", "CD"), ("supercycle", "cyclic_dependency", "CD"), ("Cloud rot", "unstable_dependency", "UD"), ("Legacy systems", "microservice_bad_smell", "MS"), ("Hub-Like Dependency", "hub_like_dependency", "HL"), ("Cyclic-Dependent Modularization", "custom_tool_smell", "XX"), ("Insufficient Modularization", "god_component", "GC"), (None, "custom_tool_smell", "XX")],
)
def test_canonical_smell(spark, label, key, code):
    got = value(spark, text.canonical_smell(F.lit(label).cast("string")))
    assert (got["smell_key"], got["code"]) == (key, code)


def test_rounding_of_scores(spark):
    assert [value(spark, text.clamp_score(F.lit(x))) for x in (2.5, 3.5, 0.2, 9.0)] == [2, 4, 1, 5]


def test_versions_and_files(spark):
    assert [value(spark, text.next_version(F.lit(v).cast("string"))) for v in ("v0", "v12", "draft", None)] == ["v1", "v13", "v1", "v1"]
    got = value(spark, text.skill_name_version(F.lit("/x/My_v_Skill_v3.md")))
    assert (got["name"], got["version"]) == ("My_v_Skill", "v3")
    assert value(spark, text.without_fences(F.lit("```json\n{}\n```"))) == "{}"


@pytest.mark.parametrize("noisy, want", [('Sure: ```json\n{"a": "}{", "b": {"c": 1}} done', '{"a": "}{", "b": {"c": 1}}'), ("no json", None), ('{"a": "\\""} x', '{"a": "\\""}'), ("{ open", None), (None, None), ("", None)])
def test_first_object(noisy, want):
    assert noisy_json.first_object(noisy) == want


def test_extract_json_and_lists(spark):
    df = spark.createDataFrame([('x {"k": 1} y', '[{"fact": "a", "why": "b"}, 3, "c"]'), (None, None), ("-", "nope")], "t string, l string")
    got = df.select(noisy_json.extract_json("t").alias("j"), noisy_json.string_list("l").alias("s")).collect()
    assert [tuple(r) for r in got] == [('{"k": 1}', ["a — b", "3", "c"]), (None, None), (None, [])]


def test_hgrs(spark):
    df = spark.createDataFrame([(5, 4, 4, 3, 4, 3, 5), (5, 5, 5, 5, 5, 5, 5), (6, 5, 5, 5, 5, 5, 5), (None, 5, 5, 5, 5, 5, 5)], ", ".join(f"{c} int" for c in CRITERIA))
    assert [r[0] for r in df.select(scoring.hgrs()).collect()] == [4.05, 5.0, None, None]
    with pytest.raises(ValueError):
        scoring.hgrs(weights=WEIGHTS | {"cost_efficiency": "0.50"})


def test_structural_checks(spark):
    schema = "smell_key string, evidence_ids array<string>, components array<string>, edges array<string>, evidence_used array<string>, suggested_components array<string>, boundary array<string>, direction string, recommended string, rationale string, risks array<string>, questions array<string>, steps array<string>, cost_efficiency int"
    steps = ["Extract interface from org.a", "Move class into org.b", "Invert the dependency", "short"]
    rows = [
        ("god_component", ["E1"], ["org.a", "org.b"], ["org.a->org.b"], ["E1"], ["org.a"], ["org.a", "org.b"], "supported_by_evidence", "Move Class", "the cycle and coupling " * 12 + " boundary layer", ["r1", "r2"], [], steps, 2),
        ("god_component", ["E1"], ["org.a"], [], ["E9"], ["zz"], ["org.a"], "supported_by_evidence", "Facade", None, None, None, None, 2),
        ("unknown", ["E1"], ["org.a"], [], [], [], [], "requires_source_inspection", "Other", "", [], [], [], 2),
    ]
    got = scoring.structural_checks(spark.createDataFrame(rows, schema)).collect()
    assert [r["critical_hallucination"] for r in got] == [False, True, False]
    assert [tuple(r[c] for c in CRITERIA) for r in got] == [(5, 4, 3, 4, 4, 1, 2), (1, 1, 1, 1, 1, 1, 2), (2, 3, 1, 1, 1, 1, 2)]
    assert got[1]["unsupported_evidence_ids"] == ["E9"] and got[1]["ungrounded_components"] == ["zz"] and not got[1]["direction_ok"]
    assert not got[2]["evidence_ids_exist"]


def test_gate(spark):
    rows = [("v0", 3.0, 3.0, 0), ("v1", 3.5, 3.0, 0), ("v2", 3.5, 2.9, 0), ("v3", 4.0, 4.0, 1)]
    s = spark.createDataFrame(rows, "version string, mean_hgrs double, mean_grounding double, critical_hallucinations long")
    assert [analytics.gate(s, "v0", v).first()["passed"] for v in ("v1", "v0", "v2", "v3", "v9")] == [True, False, False, False, False]


def test_splits(spark):
    cases = spark.createDataFrame([(f"c{i}", f"s{i}") for i in range(40)], "case_id string, smell_id string")
    one, two = (splits.split_instances(cases, seed=s).orderBy("case_id").collect() for s in (42, 42))
    assert one == two and {r["split"] for r in one} == {"train", "validation"}
    forced = splits.split_instances(cases, fraction=0.0).filter("split = 'validation'").collect()
    assert [r["smell_id"] for r in forced] == ["s0"]
    assert splits.split_projects(spark.createDataFrame([("a",), ("b",), ("a",)], "project string")).filter("split = 'validation'").count() == 1


def test_upsert_keeps_chosen_columns(spark):
    base = spark.createDataFrame([(1, "old", 10), (2, "two", 20)], "k int, v string, created int")
    changes = spark.createDataFrame([(1, "new", 99), (1, "newest", 98), (3, "three", 30)], "k int, v string, created int")
    got = latest.upsert(base, changes, ["k"], [F.length("v")], keep=("created",))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "newest", 10), (2, "two", 20), (3, "three", 30)]


def test_exports(spark, tmp_path):
    scores = ", ".join(f"4 AS {c}" for c in CRITERIA)
    reviews = spark.sql(f"SELECT 'r1' AS run_id, 4.0D AS hgrs, 'yes' AS would_try_it, 'accept' AS decision, CAST(NULL AS string) AS reviewer_notes, '{{\"x\": \"é\"}}' AS edited_output_json, {scores} UNION ALL SELECT 'r2', 3.9D, 'no', 'x', 'n', NULL, {', '.join('1' for _ in CRITERIA)}")
    runs = spark.sql("SELECT id AS run_id, 'c1' AS case_id, 'ok' AS status, '{}' AS suggestion_json, 'm' AS agent_mode, CAST(NULL AS string) AS model_id, 'v0' AS skill_version FROM VALUES ('r1'), ('r2') AS t(id)")
    cases = spark.sql("SELECT 'c1' AS case_id, '{\"case\": 1}' AS case_json")
    found = exporting.examples(reviews, runs, cases)
    assert [r["preferred_output"] for r in found.collect()] == ['{"x": "é"}']
    paths = exporting.export(found, str(tmp_path / "out"))
    line = json.loads(spark.read.text(paths["instruction"]).first()[0])
    assert json.loads(line["input"]) == {"case": 1} and line["meta"]["model_id"] is None and line["meta"]["human_edited"] is True
    assert [m["role"] for m in json.loads(spark.read.text(paths["chat"]).first()[0])["messages"]] == ["system", "user", "assistant"]
    assert spark.read.csv(paths["csv"], header=True).count() == 1
