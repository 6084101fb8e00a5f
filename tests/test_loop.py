"""Calls, experiments, digests, candidates, validation, listings, and what else the review process does over the store."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from brindle.functions import exact
from brindle.functions.text import canonical_smell
from brindle.functions.vocab import CHECKS, CRITERIA, TAXONOMY
from brindle.operators import agents, analytics, naming, normalize
from brindle.sources import listings, reviewing, skills, store, validation
from brindle.sources.calls import Calls, Journal
from brindle.sources.experiments import Model, run_experiment


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "store")


class Counting(agents.MockModel):
    """Leaves a file for each call; prompts that say so fail the first time or can't be used."""

    def __init__(self, folder):
        self.folder = folder

    def answer(self, system, user):
        import os
        import uuid

        os.makedirs(self.folder, exist_ok=True)
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(user)
        if "flaky" in user and len([x for x in os.listdir(self.folder) if "flaky" in open(f"{self.folder}/{x}").read()]) == 1:
            raise TimeoutError("try again")
        return "no object" if "vague" in user and "Your answer" not in user else super().answer(system, user)


def calls_made(folder):
    import os

    return len(os.listdir(folder)) if os.path.isdir(folder) else 0


def prompts(spark, users):
    return spark.createDataFrame([(n, "s", u) for n, u in enumerate(users)], "n int, system string, user string")


def test_each_prompt_is_sent_once(spark, root, tmp_path):
    folder = str(tmp_path / "calls")
    calls, model = Calls(root, "m", concurrency=2), lambda: Counting(folder)
    said = calls.ask(prompts(spark, ["a", "b", "a", "flaky"]), model)
    assert said.count() == 4 and len(said.collect()) == 4 and calls_made(folder) == 3
    assert [r.failure for r in said.orderBy("n").collect()] == [None, None, None, "TimeoutError: try again"]
    again = calls.ask(prompts(spark, ["b", "flaky", "c"]), model).collect()
    assert calls_made(folder) == 5 and all(r.failure is None and r.answer for r in again)
    Calls(root, "other").ask(prompts(spark, ["a"]), model)
    assert calls_made(folder) == 6


def test_a_repeated_task_sends_only_what_is_left(spark, root, tmp_path):
    folder = str(tmp_path / "calls")
    journal = Journal(f"{root}/under-way")
    asked = agents.ask(prompts(spark, ["a", "b"]).withColumn("call_key", F.sha2("user", 256)), lambda: Counting(folder), journal)
    first = sorted(r.answer for r in asked.collect())
    assert sorted(r.answer for r in asked.collect()) == first and calls_made(folder) == 2
    journal.clear()
    journal.clear()
    assert asked.count() == 2



def test_a_journal_keeps_many_quick_answers_in_few_files(spark, root, tmp_path):
    journal = Journal(f"{root}/under-way")
    asked = agents.ask(prompts(spark, [str(n) for n in range(400)]).withColumn("call_key", F.sha2("user", 256)), agents.MockModel, journal)
    assert asked.count() == 400
    files = [p for p in (tmp_path / "store").rglob("*") if p.is_file()]
    assert 0 < len(files) < 100
    assert journal.rows(spark).select("call_key").distinct().count() == 400
    # what a run that ended early left isn't asked again, however rows are dealt
    calls, folder = Calls(root, "m"), str(tmp_path / "calls")
    (tmp_path / "store" / "under-way").rename(tmp_path / "store" / "moved")
    key = F.sha2(F.to_json(F.array(F.lit("m"), "system", "user")), 256)
    agents.ask(prompts(spark, ["a", "b"]).withColumn("call_key", key), agents.MockModel, Journal(f"{root}/calls-under-way/m")).collect()
    assert calls.ask(prompts(spark, ["a", "b", "c"]).repartition(3), lambda: Counting(folder)).count() == 3
    assert calls_made(folder) == 1


def stored_cases(spark, root, n=6, project="p"):
    rows = []
    for i in range(n):
        parts = [f"org.{project}{i}.{k}" for k in range(2 + i % 3)]
        case = {"smell_key": "cyclic_dependency", "components": parts, "affected_components": parts, "tool_findings": [{"evidence_id": f"F{i}"}], "dependency_evidence": [{"evidence_id": f"E{i}", "from_component": parts[0], "to_component": parts[1]}]}
        rows.append((f"{project}{i}", project, f"S{i:02d}", "cyclic_dependency", json.dumps(case), "validation" if i % 2 else "train"))
    store.append(spark.createDataFrame(rows, "case_id string, project string, smell_id string, smell_key string, case_json string, split string"), root, "evidence_cases")


def test_runs_are_asked_for_once_and_checked_when_they_are_saved(spark, root, tmp_path):
    folder = str(tmp_path / "calls")
    stored_cases(spark, root, 5)
    cases = store.current(spark, root, "evidence_cases", "p").withColumn("skill_text", F.when(F.col("case_id") < "p3", "vague")).withColumn("skill_version", F.lit("v0"))
    vague = cases.withColumn("case_json", F.when(F.col("case_id") < "p2", F.regexp_replace("case_json", r"\}$", ', "note": "vague"}')).otherwise(F.col("case_json")))
    runs = agents.run_agents(vague, "skill", lambda: Counting(folder), calls=Calls(root, "m"))
    assert runs.count() == 5 and calls_made(folder) == 6  # both are asked for a repair by the same prompt
    assert sorted(r.run_id for r in runs.collect()) == sorted(r.run_id for r in runs.collect()) and calls_made(folder) == 6
    reviewing.save_runs(runs, root)
    stored = store.current(spark, root, "agent_runs", "p").collect()
    for r in stored:
        found = json.loads(r.checks_json)
        assert [c["name"] for c in found["checks"]] == list(CHECKS) and all(c["detail"] for c in found["checks"])
    rates = analytics.failure_rates(reviewing.found_checks(store.current(spark, root, "agent_runs")), ["agent_mode"]).first()
    assert (rates.missing_steps_rate, rates.risk_omission_rate, rates.unsupported_evidence_claim_rate) == (1.0, 0.0, 0.0)


def test_experiment(spark, root, tmp_path):
    stored_cases(spark, root, 4)
    stored_cases(spark, root, 2, "q")
    for version, status in (("v0", "production"), ("v1", "archived")):
        store.append_row(spark, root, "skills", name="BreakCyclicDependencySkill", version=version, status=status, text=f"text of {version}")
    folder = str(tmp_path / "calls")
    models = {"m1": Model(lambda: Counting(folder), "here", 2), "m2": Model()}
    made = run_experiment(spark, root, "grid", "p", models, ["baseline", "skill"], [None, "v1"], split="validation")
    runs = store.current(spark, root, "agent_runs").collect()
    assert sorted((r.model_id, r.agent_mode, r.skill_version, r.case_id) for r in runs) == sorted((m, a, v, c) for m in models for a, v in (("baseline", "none"), ("skill", "v0"), ("skill", "v1")) for c in ("p1", "p3"))
    assert {r.experiment_id for r in runs} == {made} and calls_made(folder) == 6 and {r.provider for r in runs} == {"here", "mock"}
    config = json.loads(store.current(spark, root, "experiments").first().config_json)
    assert config["modes"] == ["baseline", "skill"] and config["models"][0] == {"provider": "here", "model_id": "m1"}
    run_experiment(spark, root, "again", "p", models, ["skill"], ["v1"])
    assert calls_made(folder) == 8  # the two cases that weren't held out
    with pytest.raises(ValueError, match="unknown modes"):
        run_experiment(spark, root, "x", "p", models, ["guess"])
    with pytest.raises(ValueError, match="no cases"):
        run_experiment(spark, root, "x", "nobody", models, ["skill"])


class Better(agents.MockModel):
    """Says more with the candidate's text."""

    def answer(self, system, user):
        own = json.loads(super().answer(system, user))
        if "candidate text" in system:
            own["implementation_steps"] = [f"Take {p} out of the cycle." for p in own["affected_components"]] + ["Look at all uses once more."]
            own["risks_and_tradeoffs"] = ["One more interface.", "Slower calls."]
        elif "liar" in system:
            own["evidence_used"] = ["E99"]
        return json.dumps(own)


def test_loop_from_reviews_to_promotion(spark, root):
    stored_cases(spark, root)
    name = "BreakCyclicDependencySkill"
    for version, text in (("v0", "old text"), ("v1_candidate", "candidate text"), ("v2_candidate", "liar")):
        store.append_row(spark, root, "skills", name=name, version=version, status="production" if version == "v0" else "candidate", text=text, parent_version="v0")
    report = validation.validate(spark, root, "p", name, "v0", "v1_candidate", Better)
    stored = store.current(spark, root, "validation_reports").first()
    said = json.loads(stored.report_json)
    assert stored.passed and said["passed"] and said["fail_reasons"] == [] and said["held_out_cases"] == said["cases_run"] == 3
    assert said["hgrs_improvement"] >= 0.1 and said["baseline"]["n_scored"] == said["candidate"]["n_scored"] == 3
    assert said["baseline"]["score_sources"] == ["deterministic_proxy"]
    # people find the candidate bad: their reviews win over the scores when it is validated by the same runs
    runs = store.current(spark, root, "agent_runs").filter("skill_version = 'v1_candidate'").select("run_id").withColumns({"review_id": F.concat(F.lit("r-"), "run_id"), "reviewer": F.lit("me"), "would_try_it": F.lit("no"), "decision": F.lit("reject"), "reviewer_notes": F.lit("Boundary wrong, boundary unclear"), **{c: F.lit(1) for c in CRITERIA}})
    reviewing.save_reviews(runs, root)
    summary = {r.version: r for r in validation.version_summaries(spark, root, "p", report).collect()}
    assert summary["v1_candidate"].mean_hgrs == 1.0 and summary["v1_candidate"].score_sources == ["human_review"]
    bad = validation.validate(spark, root, "p", name, "v0", "v2_candidate", Better, most_cases=2)
    row = store.current(spark, root, "validation_reports").filter(F.col("report_id") == bad).first()
    assert not row.passed and json.loads(row.report_json)["cases_run"] == 2 and len(json.loads(row.report_json)["fail_reasons"]) == 3
    (digest,) = validation.save_digests(spark, root, name, "v1_candidate").collect()
    document = json.loads(digest.digest_json)
    assert document["reviews_aggregated"] == 3 and document["mean_hgrs"] == 1.0 and document["weak_criteria"] == list(CRITERIA)
    assert document["common_reviewer_complaints"] == [{"term": "boundary", "n": 6}, {"term": "wrong", "n": 3}, {"term": "unclear", "n": 3}]
    assert len(document["lowest_rated_outputs"]) == 3 and document["mean_total_tokens"] > 0 and document["would_try_yes_pct"] == 0.0
    with pytest.raises(ValueError, match="no reviews"):
        validation.save_digests(spark, root, "Other", "v9")

    class Writer:
        def answer(self, system, user):
            return "```markdown\n# Better skill\n" + "word " * 60 + "\n```"

    made = skills.add_candidates(spark, root, [digest.digest_id], Writer, Calls(root, "writer")).collect()
    assert [(r.version, r.status) for r in made] == [("v2_candidate", "candidate")]
    assert store.read(spark, root, "audit_log").filter("action = 'optimizer_generated'").count() == 1
    assert reviewing.promote(spark, root, report, "me") == "v1"
    with pytest.raises(ValueError, match="no held-out"):
        validation.validate(spark, root, "nobody", name, "v0", "v1", Better)
    with pytest.raises(ValueError, match="there is no skill"):
        validation.validate(spark, root, "p", name, "v0", "v77", Better)


def test_listings_and_choices(spark, root):
    stored_cases(spark, root, 4)
    stored_cases(spark, root, 2, "q")
    ids = [r.case_id for r in listings.listing(spark, root, "evidence_cases", "p", split="validation").collect()]
    assert ids == ["p1", "p3"]
    for n in range(3):
        store.audit(spark, root, "skill", f"s{n}", "seen", actor="me" if n else "you")
    newest = listings.listing(spark, root, "audit_log", most=2, actor=["me", "you"]).collect()
    assert [r.entity_id for r in newest] == ["s2", "s1"]
    assert [r.entity_id for r in listings.listing(spark, root, "audit_log", text="YOU").collect()] == ["s0"]
    store.append_row(spark, root, "audit_log", entity_type="skill", entity_id="x")
    found = {(r.facet, r.value): r.n for r in listings.choices(spark, root, "audit_log").collect()}
    assert found == {("entity_type", "skill"): 4, ("action", "seen"): 3, ("action", None): 1, ("actor", "me"): 2, ("actor", "you"): 1, ("actor", None): 1}
    assert {(r.facet, r.value): r.n for r in listings.choices(spark, root, "evidence_cases", "q").collect()} == {("smell_key", "cyclic_dependency"): 2, ("split", "train"): 1, ("split", "validation"): 1}


def test_means_do_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(4)
    values = [rng.randrange(1000, 5001) / 1000 for _ in range(300)] + [1.6625] * 5
    seen = set()
    for seed in range(4):
        random.Random(seed).shuffle(values)
        frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(1 + seed)
        seen.add(tuple(frame.agg(exact.exact_mean(F.col("v")).alias("m"), exact.exact_sum(F.col("v")).alias("s"), exact.share(F.col("v") > 2, 1, scale=100).alias("p")).first()))
    total = sum(round(v * 1000 + 1e-9) if v != 1.6625 else 1663 for v in values)
    assert len(seen) == 1 and next(iter(seen))[0] == (2 * total + len(values)) // (2 * len(values)) / 1000
    half = spark.createDataFrame([(1.0,), (1.001,)], "v double")
    assert half.agg(exact.exact_mean(F.col("v"))).first()[0] == 1.001 and half.limit(0).agg(exact.exact_mean(F.col("v"))).first()[0] is None
    assert spark.range(1).select(exact.ratio(F.lit(-5), F.lit(10), 0)).first()[0] == -1.0


def brute_pairs(parts, edges, most):
    joined = {frozenset(e) for e in edges}
    return list(itertools.islice(((a, b) for a in parts for b in parts if a != b and frozenset((a, b)) not in joined), most))


@pytest.mark.parametrize("seed", range(4))
def test_first_open_pairs_are_those_of_all(spark, seed):
    rng = random.Random(seed)
    cases, edges, want = [], [], []
    for c in range(12):
        parts = [f"n{k}" for k in range(rng.randrange(0, 9))]
        own = [(a, b) for a in parts for b in parts if rng.random() < rng.choice([0.1, 0.6, 0.95])]
        cases.append((f"c{c}", parts))
        edges += [(f"c{c}", a, b) for a, b in own]
        want += [(f"c{c}", n, a, b) for n, (a, b) in enumerate(brute_pairs(parts, own, 5), 1)]
    frame, inside = spark.createDataFrame(cases, "case_id string, components array<string>"), spark.createDataFrame(edges, "case_id string, from_component string, to_component string")
    assert sorted(tuple(r) for r in normalize.first_open_pairs(frame, inside).collect()) == sorted(want)


def test_a_case_of_twenty_thousand_components(spark):
    frame = spark.range(1).select(F.lit("c").alias("case_id"), F.transform(F.sequence(F.lit(0), F.lit(19_999)), lambda i: F.format_string("n%05d", i)).alias("components"))
    hub = spark.range(1, 20_000).select(F.lit("c").alias("case_id"), F.lit("n00000").alias("from_component"), F.format_string("n%05d", "id").alias("to_component"))
    got = [(r.a, r.b) for r in normalize.first_open_pairs(frame, hub).orderBy("n").collect()]
    assert got == [("n00001", f"n{k:05d}") for k in range(2, 7)]


def test_names_in_an_automaton_are_the_chain_of_conditions(spark):
    labels = ["Cyclic Dependency", "supercycle", "Cloud rot", "Legacy systems", "God-Class", "layer violation", None, "", "HL", "h l", "a cd b", "god component", "feature concentration x"]
    frame = spark.createDataFrame([(x,) for x in [*labels, "HL"]], "label string")
    want = sorted(map(str, frame.select("label", canonical_smell(F.col("label")).alias("s")).select("label", "s.*").collect()))
    for most in (50_000, 3):
        got = naming.canonical_labels(frame, naming.taxonomy_rows(spark, TAXONOMY), most_names=most).select("label", "smell_key", "smell_type", "code")
        assert sorted(map(str, got.collect())) == want


def test_common_terms_fall_to_the_first_seen(spark):
    notes = spark.createDataFrame([(2, "zebra apple"), (1, "mango zebra apple mango")], "id int, note string")
    assert [tuple(r) for r in analytics.top_terms(notes, "note", order="id").collect()] == [("mango", 2), ("zebra", 2), ("apple", 2)]
    assert [r.term for r in analytics.top_terms(notes, "note").collect()] == ["apple", "mango", "zebra"]


def test_more_names_than_an_automaton_holds_are_joined_once(spark):
    rows = [(n, f"k_{n}", "T", "C", s) for n, s in enumerate(["abcdefgh", "cd", "x y z", "", None, "zz top", "bcdefghij"])]
    taxonomy = spark.createDataFrame(rows, "priority int, smell_key string, smell_type string, code string, synonym string")
    labels = spark.createDataFrame([(x,) for x in ("1 abcdefghij 2", "acd", "xyz", "k 5", "", None, "bcdefgh", "the zz top", "é")], "label string")
    want = naming.canonical_labels(labels, taxonomy).orderBy("label").collect()
    joined = naming.canonical_labels(labels, taxonomy, most_names=3)
    assert joined.orderBy("label").collect() == want
    assert "MapInPandas" not in joined._jdf.queryExecution().executedPlan().toString()


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_answers_are_parsed_once(spark, root):
    said = spark.createDataFrame([("{}",)], "answer string")
    assert plan_of(agents.parse(said)).count("from_json(MapType") == 1
    stored_cases(spark, root, 3)
    cases = store.current(spark, root, "evidence_cases", "p").withColumns({"skill_text": F.lit("t"), "skill_version": F.lit("v0")})
    runs = agents.run_agents(cases, "skill", calls=Calls(root, "m"))
    assert "extract_json" not in plan_of(runs) and "string_list" not in plan_of(runs)
    assert {r.status for r in runs.collect()} == {"ok"}


def test_costs_of_new_runs_are_ranked_among_those_stored_before(spark, root):
    stored_cases(spark, root, 4)
    cases = store.current(spark, root, "evidence_cases", "p").withColumns({"skill_text": F.lit("t"), "skill_version": F.lit("v0")})
    for model in ("m1", "m2"):
        reviewing.save_runs(agents.run_agents(cases, "skill", calls=Calls(root, model)).withColumn("model_id", F.lit(model)), root)
    stored = store.current(spark, root, "agent_runs", "p").collect()
    told = {r.model_id: json.loads(r.checks_json)["checks"][-1]["detail"] for r in stored}
    assert len(stored) == 8 and told["m1"].endswith("among 4 runs") and told["m2"].endswith("among 8 runs")
    assert store.current(spark, root, "suggested_scores").count() == 8


def test_names_and_labels_meet_without_a_broadcast(spark):
    part = spark.range(40).select(F.col("id").cast("int").alias("priority"), F.concat(F.lit("k_"), "id").alias("smell_key"), F.lit("T").alias("smell_type"), F.lit("C").alias("code"), F.concat(F.lit("name "), "id").alias("synonym"))
    labels = spark.range(40).select(F.concat(F.lit("a name "), "id").alias("label"))
    joined = naming.canonical_labels(labels, part, most_names=3)
    assert {r.smell_key for r in joined.collect()} == {"k_0", *(f"k_{n}" for n in range(1, 10)), *(f"k_{n // 10}" for n in range(10, 40))}
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()


def test_prompts_are_dealt_out_by_their_keys_alone(spark, root, tmp_path, monkeypatch):
    """Whether few rows are asked, few are not, or both are many; no prompt or answer is shuffled for the rows that are asked."""
    from brindle.sources import calls

    users = ["a", "b", "a", "c", "a", "d", "b", "e"]
    for n, few in enumerate((100, 3, 0)):
        monkeypatch.setattr(calls, "FEW", few)
        folder = str(tmp_path / f"calls{n}")
        own, model = Calls(f"{root}{n}", "m"), lambda folder=folder: Counting(folder)
        said = own.ask(prompts(spark, users).repartition(3), model)
        assert sorted(r.user for r in said.collect()) == sorted(users) and calls_made(folder) == 5
        again = own.ask(prompts(spark, [*users, "f", "f"]), model).collect()
        assert sorted(r.user for r in again) == sorted([*users, "f", "f"]) and calls_made(folder) == 6 and all(r.answer for r in again)


def test_what_is_done_leaves_the_shared_folder(spark, root, monkeypatch):
    from pathlib import Path

    from brindle.session import shared_folder

    there = lambda: {p.name for p in Path(shared_folder(spark)).iterdir() if any(p.rglob("*.parquet"))}
    before = there()
    stored_cases(spark, root, 4)
    cases = store.current(spark, root, "evidence_cases", "p").withColumns({"skill_text": F.lit("t"), "skill_version": F.lit("v0")})
    reviewing.save_runs(agents.run_agents(cases, "skill", calls=Calls(root, "m")), root)
    reviewing.rescore(spark, root, "p")
    left = {name.rpartition("-")[0] for name in there() - before}
    assert left <= {"said", "ranks"}  # what the caller's runs are read from
    assert store.current(spark, root, "agent_runs").filter("checks_json IS NOT NULL").count() == 4


def test_a_repair_joins_nothing(spark, root):
    class Never:
        def answer(self, system, user):
            return "no object"

    stored_cases(spark, root, 3)
    cases = store.current(spark, root, "evidence_cases", "p").withColumns({"skill_text": F.lit("t"), "skill_version": F.lit("v0")})
    runs = agents.run_agents(cases, "skill", Never, calls=Calls(root, "m"))
    assert "Join" not in plan_of(runs) and [(r.status, r.repair_attempted) for r in runs.collect()] == [("invalid_json", True)] * 3
