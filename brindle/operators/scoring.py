"""Rubric scores and structural checks of suggestions."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.text import clamp_score, concrete_steps, rationale_hits, steps_naming
from brindle.functions.vocab import CHECKS, CRITERIA, RELEVANT, WEIGHTS
from brindle.session import few_or_dealt, written

_NONE = "array<string>"
#: Numbers of tokens by project that are sent to all tasks, at most: some 10 MB.
MOST_RANKS = 200_000


def hgrs(scores: Mapping[str, Column] | None = None, weights: Mapping[str, str] = WEIGHTS) -> Column:
    """The weighted score of seven criteria to three places, half up.

    Null if a criterion is missing or not from 1 to 5. Scores with up to two
    places and weights with up to four are summed as whole numbers, so the result is exact.
    """
    if abs(sum(float(w) for w in weights.values()) - 1) > 1e-6 or set(weights) != set(CRITERIA):
        raise ValueError("weights must cover all criteria and sum to 1")
    scores = scores or {c: F.col(c) for c in CRITERIA}
    valid, total = F.lit(True), F.lit(0)
    for c in CRITERIA:
        valid = valid & (F.abs(scores[c] - 3) <= 2)  # from 1 to 5, with the score standing there once: a filter on the result stays small enough to be compiled
        total = total + F.round(scores[c] * 100).cast("long") * int(Decimal(weights[c]) * 10_000)
    return F.when(valid, F.floor((total + 500) / 1000) / 1000)


def cost_rank(runs: DataFrame, least: int = 3, among: DataFrame | None = None) -> DataFrame:
    """`runs` with cost_efficiency from 1 to 4 by the share of the project's runs that took as many tokens or fewer, and cost_compared, the number of those that have tokens.

    Runs without tokens, and all of a project with fewer than `least` runs that
    have tokens, get 2. The run itself counts. The project's runs are those in
    `among` (project, total_tokens), which holds the ones to rank, or else `runs`.
    """
    with_tokens = lambda df: df.withColumn("_tokens", F.nullif(F.col("total_tokens"), F.lit(0)))
    counted = with_tokens(runs)
    # only distinct numbers of tokens are sorted, whatever the number of runs
    values = with_tokens(runs if among is None else among).filter("_tokens IS NOT NULL").groupBy("project", "_tokens").agg(F.count("*").alias("_runs"))
    up_to = Window.partitionBy("project").orderBy("_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranks = values.select(F.col("project").alias("_project"), F.col("_tokens").alias("_of"), F.sum("_runs").over(up_to).alias("_below"), F.sum("_runs").over(Window.partitionBy("project")).alias("_n"))
    # they are sent to the runs, which else would be shuffled with all their texts
    ranked = counted.join(few_or_dealt(written(ranks, "ranks"), MOST_RANKS), F.col("project").eqNullSafe(F.col("_project")) & (F.col("_tokens") == F.col("_of")), "left")
    cost = F.when(F.col("_n").isNull() | (F.col("_n") < least), F.lit(2.0)).otherwise(1 + 3 * (1 - F.col("_below") / F.col("_n")))
    return ranked.withColumns({"cost_efficiency": clamp_score(cost), "cost_compared": F.coalesce("_n", F.lit(0))}).drop("_tokens", "_project", "_of", "_below", "_n")


def structural_checks(df: DataFrame) -> DataFrame:
    """Checks and suggested scores of suggestions.

    `df` has smell_key, evidence_ids, components and edges (arrays of the case;
    edges as 'a->b'), evidence_used, suggested_components, boundary, direction,
    recommended, rationale, risks, questions, steps, and cost_efficiency. Null
    arrays are empty. Adds the arrays of unsupported ids and unknown components, the
    pass flags, critical_hallucination, the seven scores with suggested_hgrs, and `checks`: an
    array of (name, passed, detail), one for each name in CHECKS. total_tokens and cost_compared
    of `cost_rank` are told in the last one's detail where they are there.
    """
    arr = lambda c: F.coalesce(F.col(c), F.array().cast(_NONE))
    used, named, steps = arr("evidence_used"), arr("suggested_components"), concrete_steps(F.col("steps"))
    pairs = F.flatten(F.transform(arr("boundary"), lambda a: F.transform(arr("boundary"), lambda b: F.when(a != b, F.concat(a, F.lit("->"), b)))))
    claims = F.col("direction") == "supported_by_evidence"
    out = df.withColumns({
        "unsupported_evidence_ids": F.array_sort(F.array_except(used, arr("evidence_ids"))),
        "ungrounded_components": F.array_sort(F.array_except(named, arr("components"))),
        "direction_ok": ~F.coalesce(claims, F.lit(False)) | F.arrays_overlap(F.filter(pairs, lambda p: p.isNotNull()), arr("edges")),
        "_hits": rationale_hits(F.col("rationale")),
        "_risks": F.size(arr("risks")),
        "_questions": F.size(arr("questions")),
        "_steps": F.size(arr("steps")),
        "_concrete": F.size(steps),
        "_naming": steps_naming(steps, arr("components")),
    })
    ids_ok, comps_ok = F.size("unsupported_evidence_ids") == 0, F.size("ungrounded_components") == 0
    fits = F.lit(None).cast("boolean")
    for key, names in RELEVANT.items():
        fits = F.when(F.col("smell_key") == key, F.col("recommended").isin(*names)).otherwise(fits)
    fits = F.coalesce(fits, F.lit(True)) | (F.col("recommended") == "Other")
    out = out.withColumns({
        "evidence_ids_exist": ids_ok & (F.size(used) > 0),
        "components_grounded": comps_ok,
        "refactoring_relevant": fits,
        "critical_hallucination": ~(ids_ok & comps_ok & F.col("direction_ok")),
    })
    point = lambda c, n=1: F.when(c, n).otherwise(0)
    out = out.withColumns({
        "evidence_grounding": F.when(F.col("critical_hallucination"), 1).otherwise(1 + point(F.size(used) > 0, 2) + point(F.size(named) > 0) + point(F.col("direction_ok"))),
        "refactoring_relevance": 1 + point(F.col("refactoring_relevant"), 2) + point(F.col("refactoring_relevant") & (F.col("recommended") != "Other")),
        "architectural_reasoning": 1 + point(F.col("_hits") >= 2) + point((F.col("_hits") >= 4) & (F.length("rationale") > 200)),
        "minimality_and_safety": 1 + point(F.col("_risks") >= 1) + point((F.col("_risks") >= 2) | (F.col("_questions") > 0)) + point(F.col("_steps").between(3, 7)),
        "actionability": 1 + point(F.col("_concrete") >= 3, 2) + point(F.col("_naming") >= 2),
        "human_confidence": F.lit(1),
        "risks_present": F.col("_risks") >= 1,
        "concrete_steps_present": F.col("_concrete") >= 3,
    })
    out = out.withColumns({c: clamp_score(F.col(c)) for c in CRITERIA}).withColumn("checks", _checks(out, used, df.columns))
    return out.withColumn("suggested_hgrs", hgrs()).drop("_hits", "_risks", "_questions", "_steps", "_concrete", "_naming")


def _checks(out: DataFrame, used: Column, given: list[str]) -> Column:
    listed = lambda c: F.array_join(c, ", ")
    number = lambda c: F.coalesce(F.col(c) if c in given else F.lit(None), F.lit(0)).cast("string")
    told = (
        (F.col("evidence_ids_exist"), F.when(F.size("unsupported_evidence_ids") > 0, F.concat(F.lit("not in the case: "), listed("unsupported_evidence_ids"))).when(F.size(used) == 0, "cites nothing").otherwise("all cited ids are in the case")),
        (F.col("components_grounded"), F.when(F.size("ungrounded_components") > 0, F.concat(F.lit("not in the case: "), listed("ungrounded_components"))).otherwise("all components are in the case")),
        (F.col("direction_ok"), F.when(F.col("direction_ok"), "no claim beyond the edges").otherwise("no imported edge joins the boundary's components")),
        (F.col("refactoring_relevant"), F.concat(F.coalesce("recommended", F.lit("")), F.lit(" for "), F.coalesce("smell_key", F.lit("")))),
        (F.col("_hits") >= 2, F.concat(F.col("_hits").cast("string"), F.lit(" terms of architecture"))),
        (F.col("risks_present"), F.concat(F.col("_risks").cast("string"), F.lit(" risks"))),
        (F.col("concrete_steps_present"), F.concat(F.col("_concrete").cast("string"), F.lit(" concrete steps, "), F.col("_naming").cast("string"), F.lit(" naming components"))),
        (F.lit(True), F.concat(number("total_tokens"), F.lit(" tokens, among "), number("cost_compared"), F.lit(" runs"))),
    )
    return F.array(*[F.struct(F.lit(name).alias("name"), F.coalesce(passed, F.lit(False)).alias("passed"), detail.alias("detail")) for name, (passed, detail) in zip(CHECKS, told, strict=True)])


def banner(critical: Column, unsupported: Column, ungrounded: Column) -> Column:
    """'none' without checks, 'backed', or 'not backed: ' with the reasons."""
    reasons = F.filter(F.array(F.when(F.size(unsupported) > 0, F.concat(F.lit("unknown evidence ids: "), F.array_join(unsupported, ", "))), F.when(F.size(ungrounded) > 0, F.concat(F.lit("unknown components: "), F.array_join(ungrounded, ", ")))), lambda r: r.isNotNull())
    return F.when(critical.isNull(), "none").when(critical, F.concat(F.lit("not backed: "), F.array_join(reasons, "; "))).otherwise("backed")
