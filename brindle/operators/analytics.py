"""Comparison tables, feedback digests and the promotion gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.exact import UNIT, exact_mean, exact_sum, ratio, share, thousandths
from brindle.functions.vocab import CRITERIA, STEPS_CHECK, RISKS_CHECK, STOP_WORDS


def latest_reviews(reviews: DataFrame, order: list[Column]) -> DataFrame:
    """The last review of each run by `order`, which should end in a tie-breaker: an aggregation, combined before its shuffle."""
    rest = [c for c in reviews.columns if c != "run_id"]
    last = reviews.groupBy("run_id").agg(F.max_by(F.struct(*rest), F.struct(*[F.struct(c.isNotNull(), c) for c in order])).alias("_last"))
    return last.select(*[F.col("run_id") if c == "run_id" else F.col(f"_last.{c}") for c in reviews.columns])


def comparison_table(runs: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per mode, model and skill version.

    `reviews` has one row a run, the latest. Rates are over all runs, the share
    that would try over reviewed ones; zero tokens and runtimes count as missing.
    """
    tokens, runtime = F.nullif(F.col("total_tokens"), F.lit(0)), F.nullif(F.col("runtime_seconds"), F.lit(0.0))
    scored = runs.join(reviews.select("run_id", "hgrs", "would_try_it", *CRITERIA), "run_id", "left")
    reviewed = F.col("hgrs").isNotNull()
    table = scored.groupBy("agent_mode", "model_id", F.coalesce("skill_version", F.lit("none")).alias("skill_version")).agg(
        F.count("*").alias("runs"),
        F.count_if(F.col("status") == "ok").alias("ok"),
        F.count_if(F.col("status") == "invalid_json").alias("invalid_json"),
        F.count_if(~F.col("status").isin("ok", "invalid_json")).alias("errors"),
        share(F.col("status") == "ok").alias("json_validity_rate"),
        share(F.coalesce("critical_hallucination", F.lit(False))).alias("grounding_failure_rate"),
        exact_mean(F.col("hgrs")).alias("mean_hgrs"),
        F.count_if(reviewed).alias("reviews"),
        share(F.col("would_try_it") == "yes", 1, reviewed, 100).alias("would_try_yes_pct"),
        exact_mean(tokens).alias("mean_tokens"),
        exact_mean(runtime).alias("mean_runtime_s"),
        *[exact_mean(F.col(c)).alias(f"mean_{c}") for c in CRITERIA],
    )
    both = thousandths(F.coalesce("mean_tokens", F.lit(0.0))) * thousandths(F.coalesce("mean_runtime_s", F.lit(0.0)))
    proxy = F.nullif(ratio(both, F.lit(UNIT * UNIT), 1), F.lit(0.0))
    return table.withColumn("cost_proxy", proxy).orderBy("agent_mode", F.coalesce("model_id", F.lit("None")), "skill_version")


def digest(reviews: DataFrame, by: list[str]) -> DataFrame:
    """Review digests per skill: counts, means, and shares of failed checks."""
    return reviews.groupBy(*by).agg(
        F.count("*").alias("reviews_aggregated"),
        exact_mean(F.col("hgrs")).alias("mean_hgrs"),
        *[exact_mean(F.col(c), 2).alias(f"mean_{c}") for c in CRITERIA],
        share(F.col("would_try_it") == "yes", 1, scale=100).alias("would_try_yes_pct"),
    )


def failure_rates(reviews: DataFrame, by: list[str]) -> DataFrame:
    """Shares of reviews with a hallucination, too few steps and no risks, and mean tokens and runtimes.

    `checks` is an array of (name, passed), as stored with a run.
    """
    failed = lambda name: F.exists("checks", lambda c: (c["name"] == name) & ~c["passed"])
    return reviews.groupBy(*by).agg(
        share(F.col("critical_hallucination")).alias("unsupported_evidence_claim_rate"),
        share(failed(STEPS_CHECK)).alias("missing_steps_rate"),
        share(failed(RISKS_CHECK)).alias("risk_omission_rate"),
        exact_mean(F.nullif(F.col("total_tokens"), F.lit(0)), 1).alias("mean_total_tokens"),
        exact_mean(F.nullif(F.col("runtime_seconds"), F.lit(0.0)), 2).alias("mean_runtime_seconds"),
    )


def lowest_rated(reviews: DataFrame, by: list[str], n: int = 3, chars: int = 600) -> DataFrame:
    """The n reviews of each group with the lowest scores: rank, run_id, hgrs, decision, and the note without space around, cut to `chars`."""
    order = Window.partitionBy(*by).orderBy("hgrs", "review_id")
    note = F.substring(F.trim(F.coalesce("reviewer_notes", F.lit(""))), 1, chars)
    ranked = reviews.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return ranked.select(*by, "rank", "run_id", "hgrs", "decision", note.alias("reviewer_notes"))


def note_samples(reviews: DataFrame, by: list[str], n: int = 10, chars: int = 400) -> DataFrame:
    """The first n notes of each group by review id, cut to `chars`."""
    noted = reviews.filter(F.coalesce("reviewer_notes", F.lit("")) != "")
    ranked = noted.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("review_id"))).filter(F.col("rank") <= n)
    return ranked.select(*by, "rank", F.substring("reviewer_notes", 1, chars).alias("note"))


def ok_share(runs: DataFrame, by: str = "agent_mode") -> DataFrame:
    """How many of each kind's runs went well, of how many."""
    return runs.groupBy(by).agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count("*").alias("total"))


def first_cases(cases: DataFrame, n: int, split: str = "validation") -> DataFrame:
    """The first n cases of each project's split by smell_id: a subset that repeated validations share."""
    order = Window.partitionBy("project").orderBy("smell_id", "case_id")
    return cases.filter(F.col("split") == split).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n")


def weak_criteria(digests: DataFrame, by: list[str], below: float = 3.5) -> DataFrame:
    """Criteria with a mean below the bar, the weakest first, equal ones in the rubric's order."""
    long = digests.unpivot(by, [f"mean_{c}" for c in CRITERIA], "name", "mean")
    place = F.array_position(F.array(*map(F.lit, CRITERIA)), F.substring("name", 6, 100))
    rank = Window.partitionBy(*by).orderBy("mean", place)
    return long.filter(F.col("mean") < below).select(*by, F.row_number().over(rank).alias("rank"), F.substring("name", 6, 100).alias("criterion"), "mean")


def term_counts(notes: DataFrame, text: str, stop_words: tuple[str, ...] = STOP_WORDS, order: str | None = None) -> DataFrame:
    """term, n: words of four letters or more (hyphens inside) in lower-cased text, without stop words; with `order`, a column that orders the notes, also `first`, where each appears first."""
    place = F.col(order) if order else F.lit(0)
    terms = notes.select(place.alias("note"), F.posexplode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z][a-z-]{3,}"), 0)).alias("at", "term"))
    first = [F.min(F.struct("note", "at")).alias("first")] if order else []
    return terms.filter(~F.col("term").isin(*stop_words)).groupBy("term").agg(F.count("*").alias("n"), *first)


def top_terms(notes: DataFrame, text: str, n: int = 12, order: str | None = None) -> DataFrame:
    """The n commonest terms; of equally common ones those that appear first in the order of the notes, or by name without one."""
    ranked = term_counts(notes, text, order=order).orderBy(F.col("n").desc(), *(["first"] if order else []), "term").limit(n)
    return ranked.select("term", "n")


def top_terms_of(notes: DataFrame, by: list[str], text: str, order: str, n: int = 12, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """rank, term, n of each group's commonest terms, as `top_terms` has them for one."""
    terms = notes.select(*by, F.col(order).alias("note"), F.posexplode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z][a-z-]{3,}"), 0)).alias("at", "term"))
    counts = terms.filter(~F.col("term").isin(*stop_words)).groupBy(*by, "term").agg(F.count("*").alias("n"), F.min(F.struct("note", "at")).alias("first"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n").desc(), "first", "term"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= n).select(*by, "rank", "term", "n")


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value, n: the values of several columns and how many rows have each, in one pass; null is a value."""
    sets = [[F.col(c)] for c in columns]
    counted = df.groupingSets(sets, *[F.col(c) for c in columns]).agg(F.grouping_id().alias("_id"), F.count("*").alias("n"))
    # a column's bit is 0 in the sets that group by it
    every = (1 << len(columns)) - 1
    own = [(every ^ (1 << (len(columns) - 1 - k)), c) for k, c in enumerate(columns)]
    facet, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for code, c in own:
        facet, value = F.when(F.col("_id") == code, c).otherwise(facet), F.when(F.col("_id") == code, F.col(c).cast("string")).otherwise(value)
    return counted.select(facet.alias("facet"), value.alias("value"), "n")


def run_scores(runs: DataFrame) -> DataFrame:
    """Runs with score, grounding and source: failed runs at the floor, else the human review, else the suggested score; others are left out."""
    failed, human = F.col("status") != "ok", F.col("hgrs").isNotNull()
    out = runs.withColumns({
        "source": F.when(failed, "failed_run_floor").when(human, "human_review").when(F.col("suggested_hgrs").isNotNull(), "deterministic_proxy"),
        "score": F.when(failed, 1.0).when(human, F.col("hgrs")).otherwise(F.col("suggested_hgrs")),
        "grounding": F.when(failed, 1).when(human, F.col("evidence_grounding")).otherwise(F.col("suggested_grounding")),
        "hallucinated": ~failed & F.coalesce("critical_hallucination", F.lit(False)),
    })
    return out.filter("source IS NOT NULL")


def version_summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy("version").agg(
        F.count("*").alias("n_scored"),
        F.count_if(F.col("source") == "failed_run_floor").alias("n_failed"),
        exact_mean(F.col("score")).alias("mean_hgrs"),
        exact_mean(F.col("grounding")).alias("mean_grounding"),
        F.count_if("hallucinated").alias("critical_hallucinations"),
        F.array_sort(F.collect_set("source")).alias("score_sources"),
    )


def gate(summaries: DataFrame, baseline: str, candidate: str, least_gain: float = 0.10, most_drop: float = 0.0) -> DataFrame:
    """improvement, grounding_delta, candidate_hallucinations, passed for two versions of `version_summary`.

    Fails without a gain of `least_gain`, with a drop in grounding beyond
    `most_drop`, or with any hallucination. Always one row.
    """
    of = lambda c, v: F.max(F.when(F.col("version") == v, F.col(c)))
    gain = lambda c: (thousandths(of(c, candidate)) - thousandths(of(c, baseline)))
    row = summaries.agg(
        gain("mean_hgrs").alias("_gain"),
        gain("mean_grounding").alias("_delta"),
        F.coalesce(of("critical_hallucinations", candidate), F.lit(0)).alias("candidate_hallucinations"),
    )
    # compared as whole thousandths, as the means are
    good = (F.col("_gain") >= round(least_gain * UNIT)) & ~F.coalesce(F.col("_delta") < -round(most_drop * UNIT), F.lit(False)) & (F.col("candidate_hallucinations") == 0)
    return row.select((F.col("_gain") / UNIT).alias("improvement"), (F.col("_delta") / UNIT).alias("grounding_delta"), "candidate_hallucinations", F.coalesce(good, F.lit(False)).alias("passed"))


def usage_totals(calls: DataFrame) -> DataFrame:
    """Tokens and runtime of each run over its first call and its repair."""
    s = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return calls.groupBy("run_id").agg(s("prompt_tokens").alias("prompt_tokens"), s("completion_tokens").alias("completion_tokens"), exact_sum(F.col("runtime_seconds")).alias("runtime_seconds"))


def experiment_grid(models: DataFrame, modes: DataFrame, versions: DataFrame) -> DataFrame:
    """Every combination of an experiment's parameters; these are short lists written by hand."""
    return models.crossJoin(F.broadcast(modes)).crossJoin(F.broadcast(versions))
