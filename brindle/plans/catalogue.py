"""Every query of the library over the standard tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import noisy_json, text
from brindle.functions.vocab import CRITERIA, PROVENANCE, RATIONALE_TERMS, STOP_WORDS
from brindle.operators import analytics, exporting, graph, latest, naming, normalize, numbering, scoring, splits
from brindle.plans.views import LATEST, ORDER_CASES, PART_EDGES, REVIEWS, RUNS, SUPPLIER_EDGES, mean_sql, order_cases, part_edges, ratio_sql, read, review_order, reviews, runs, supplier_edges, user_days

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


_MEANS = ", ".join(f"{mean_sql(c)} AS mean_{c}" for c in CRITERIA)
_COUNT = "count(*) FILTER (WHERE {})"


@query(f"""WITH {RUNS}, {REVIEWS}, {LATEST}, t AS (
  SELECT agent_mode, model_id, coalesce(skill_version, 'none') AS skill_version, count(*) AS runs, count(*) FILTER (WHERE status = 'ok') AS ok,
         count(*) FILTER (WHERE status = 'invalid_json') AS invalid_json, count(*) FILTER (WHERE status = 'error') AS errors,
         {ratio_sql(_COUNT.format("status = 'ok'"), "count(*)", 3)} AS json_validity_rate,
         {ratio_sql(_COUNT.format("critical_hallucination"), "count(*)", 3)} AS grounding_failure_rate,
         {mean_sql("hgrs")} AS mean_hgrs, count(hgrs) AS reviews,
         {ratio_sql("100 * " + _COUNT.format("would_try_it = 'yes'"), "count(hgrs)", 1)} AS would_try_yes_pct,
         {mean_sql("nullif(total_tokens, 0)")} AS mean_tokens, {mean_sql("nullif(runtime_seconds, 0)")} AS mean_runtime_s, {_MEANS}
  FROM runs LEFT JOIN latest USING (run_id) GROUP BY ALL)
SELECT *, nullif({ratio_sql("CAST(round(coalesce(mean_tokens, 0) * 1000) AS HUGEINT) * CAST(round(coalesce(mean_runtime_s, 0) * 1000) AS HUGEINT)", "1000000", 1)}, 0) AS cost_proxy FROM t""")
def comparison_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.comparison_table(runs(spark, sf_dir), analytics.latest_reviews(reviews(spark, sf_dir), review_order()))


@query(f"WITH {REVIEWS} SELECT run_id, l_linenumber, hgrs, {', '.join(CRITERIA)} FROM reviews")
def hgrs_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).select("run_id", "l_linenumber", "hgrs", *CRITERIA)


@query(f"WITH {REVIEWS}, {LATEST} SELECT run_id, reviewed_at, hgrs, decision FROM latest")
def latest_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.latest_reviews(reviews(spark, sf_dir), review_order()).select("run_id", "reviewed_at", "hgrs", "decision")


@query(f"""WITH {RUNS}, c AS (
  SELECT *, nullif(total_tokens, 0) AS t, count(*) OVER (PARTITION BY project, total_tokens = 0) AS n,
         cume_dist() OVER (PARTITION BY project, total_tokens = 0 ORDER BY total_tokens) AS r FROM runs)
SELECT run_id, project, total_tokens, CAST(CASE WHEN t IS NULL OR n < 3 THEN 2 ELSE greatest(1, least(5, round_even(1 + 3 * (1 - r), 0))) END AS INTEGER) AS cost_efficiency FROM c""")
def cost_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.cost_rank(runs(spark, sf_dir).select("run_id", "project", "total_tokens")).drop("cost_compared")


_BUCKET = "CAST('0x' || substr(sha256('42:' || {}), 1, 8) AS BIGINT) / 4294967295.0::DOUBLE"


@query(f"""WITH b AS (SELECT doc_id, {_BUCKET.format('CAST(doc_id AS VARCHAR)')} AS bucket FROM documents)
SELECT doc_id, bucket, CASE WHEN bucket < 0.3 THEN 'validation' ELSE 'train' END AS split FROM b""")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id")
    return splits.split_instances(docs, seed=42, key="doc_id", order="doc_id")


@query(f"""WITH p AS (SELECT DISTINCT source AS project FROM documents), b AS (SELECT project, {_BUCKET.format('project')} AS bucket FROM p),
r AS (SELECT *, row_number() OVER (ORDER BY bucket, project) AS rn, count(*) OVER () AS n FROM b)
SELECT project, bucket, CASE WHEN rn <= greatest(1, round_even(n * 0.3, 0)) THEN 'validation' ELSE 'train' END AS split FROM r""")
def project_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_projects(read(spark, sf_dir, "documents").select(F.col("source").alias("project")), seed=42)


@query("SELECT event_id, substr(sha1(user_id || '|' || event_type || '|' || props), 1, 16) AS content_id FROM events")
def content_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", text.content_id(F.col("user_id").cast("string"), F.col("event_type"), F.col("props")).alias("content_id"))


def _day_smells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with the day's types of events as components, under labels that make three categories."""
    events = user_days(spark, sf_dir)
    sets = events.groupBy("user_id", "day").agg(F.collect_set("event_type").alias("affected_components"), F.min("event_id").alias("seq"))
    label = F.when(F.size("affected_components") >= 3, "Cyclic Dependency").when(F.size("affected_components") == 2, "Hub-Like Dependency").otherwise("God Component")
    return sets.select(F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string")).alias("project"), "seq", F.lit("arcan").alias("tool"), F.col("seq").cast("string").alias("tool_record_id"), F.col("day").alias("source_file"), label.alias("smell_type_raw"), "affected_components", F.map_from_arrays(F.array(F.lit("severity")), F.array(F.size("affected_components").cast("string"))).alias("attributes"))


_SMELLS = """e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, list_sort(list(DISTINCT event_type)) AS components, min(event_id) AS seq FROM events GROUP BY 1, 2),
s AS (SELECT 'u' || (user_id % 10) AS project, seq, components,
      CASE WHEN len(components) >= 3 THEN 'cyclic_dependency' WHEN len(components) = 2 THEN 'hub_like_dependency' ELSE 'god_component' END AS smell_key,
      CASE WHEN len(components) >= 3 THEN 'CD' WHEN len(components) = 2 THEN 'HL' ELSE 'GC' END AS code FROM e),
g AS (SELECT project, smell_key, code, components, count(*) AS n_findings FROM s GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY project, code ORDER BY smell_key, components) AS seq FROM g),
cases AS (SELECT *, 'ARCAN_' || code || '_' || format('{:03d}', seq) AS smell_id, substr(sha1(project || '|' || smell_key || '|' || array_to_string(components, '|')), 1, 16) AS case_id FROM k)"""


@query(f"WITH {_SMELLS} SELECT project, smell_key, array_to_string(components, '|') AS components, n_findings, smell_id, case_id FROM cases")
def evidence_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = normalize.group_findings(_day_smells(spark, sf_dir))
    return cases.select("project", "smell_key", F.array_join("components", "|").alias("components"), F.size("findings").cast("long").alias("n_findings"), "smell_id", "case_id")


@query(f"""WITH {_SMELLS}, f AS (SELECT case_id, code, cases.seq AS case_seq, row_number() OVER (PARTITION BY case_id ORDER BY s.seq) AS n FROM cases JOIN s USING (project, smell_key, code, components))
SELECT case_id, n, 'ARCAN_' || code || '_' || format('{{:03d}}', case_seq) || CASE WHEN n > 1 THEN '_' || n ELSE '' END AS evidence_id FROM f""")
def finding_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = normalize.finding_rows(normalize.group_findings(_day_smells(spark, sf_dir)))
    return found.select("case_id", F.col("n").cast("long").alias("n"), "evidence_id")


@query(f"WITH {RUNS} SELECT run_id, project, l_linenumber, l_quantity, l_partkey FROM runs JOIN lineitem ON run_id = l_orderkey WHERE status = 'ok'")
def findings_ok_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), "l_linenumber", "l_quantity", "l_partkey")
    return latest.matching(runs(spark, sf_dir), status="ok").select("run_id", "project").join(findings, "run_id")


def _order_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_cases(spark, sf_dir).select(F.col("order_key").alias("case_id"), F.lit("trade").alias("project"), "components")


def _strong_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses between parts that occur more than once."""
    return part_edges(spark, sf_dir).filter("weight > 1").withColumn("project", F.lit("trade"))


@query(f"WITH {ORDER_CASES}, {PART_EDGES} SELECT order_key AS case_id, from_component, to_component, weight FROM (SELECT order_key, components, unnest(components) AS from_component FROM order_cases) JOIN named USING (from_component) WHERE list_contains(components, to_component)")
def edges_within_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = part_edges(spark, sf_dir).withColumn("project", F.lit("trade"))
    return normalize.edges_within(_order_cases(spark, sf_dir), edges).select("case_id", "from_component", "to_component", "weight")


_OPEN_PAIRS = f"""{ORDER_CASES}, {PART_EDGES}, big AS (SELECT from_component AS x, to_component AS y FROM named WHERE weight > 1 UNION SELECT to_component, from_component FROM named WHERE weight > 1),
i AS (SELECT order_key AS case_id, components, unnest(range(1, len(components) + 1)) AS i FROM order_cases), j AS (SELECT *, unnest(range(1, len(components) + 1)) AS j FROM i),
open AS (SELECT case_id, i, j, components[i] AS a, components[j] AS b FROM j WHERE i <> j AND NOT EXISTS (SELECT 1 FROM big WHERE x = components[i] AND y = components[j]))"""


@query(f"WITH {_OPEN_PAIRS} SELECT case_id, a, b FROM open")
def uncovered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _order_cases(spark, sf_dir)
    return normalize.uncovered_pairs(cases, normalize.edges_within(cases, _strong_uses(spark, sf_dir))).select("case_id", "a", "b")


@query(f"WITH {_OPEN_PAIRS}, o AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY i, j) AS n FROM open) SELECT case_id, CAST(n AS INTEGER) AS n, a, b FROM o WHERE n <= 5")
def first_open_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five open pairs of every order's parts, without making the others."""
    cases = _order_cases(spark, sf_dir)
    return normalize.first_open_pairs(cases, normalize.edges_within(cases, _strong_uses(spark, sf_dir)))


@query(f"""WITH RECURSIVE {SUPPLIER_EDGES}, big AS MATERIALIZED (SELECT a, b FROM edges),
reach(a, b) AS (SELECT a, b FROM big UNION SELECT r.a, e.b FROM reach r JOIN big e ON r.b = e.a),
pairs AS (SELECT x.a AS v, x.b AS w FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a),
comp AS (SELECT v, list_sort(list(DISTINCT w)) AS members FROM pairs GROUP BY v),
c AS (SELECT DISTINCT members FROM comp)
SELECT row_number() OVER (ORDER BY members) AS n, array_to_string(members, '|') AS members, len(members) AS size FROM c""")
def scc_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cycles of all edges between suppliers."""
    edges = supplier_edges(spark, sf_dir).select(F.lit("trade").alias("graph"), "a", "b")
    return graph.cycles(edges).select(F.col("n").cast("long").alias("n"), F.array_join("members", "|").alias("members"), F.col("size").cast("long").alias("size"))


_TERMS = f"t AS (SELECT unnest(regexp_extract_all(lower({{}}), '[a-z][a-z-]{{{{3,}}}}')) AS term FROM {{}}), c AS (SELECT term, count(*) AS n FROM t WHERE term NOT IN ({_list(STOP_WORDS)}) GROUP BY term)"


@query(f"WITH {_TERMS.format('text', 'conversations')} SELECT term, n FROM c")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.term_counts(read(spark, sf_dir, "conversations"), "text")


@query(f"""WITH l AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z][a-z-]{{3,}}') AS words FROM documents), t AS (SELECT doc_id, unnest(words) AS term, unnest(range(len(words))) AS pos FROM l),
c AS (SELECT term, count(*) AS n, min((doc_id, pos)) AS first FROM t WHERE term NOT IN ({_list(STOP_WORDS)}) GROUP BY term) SELECT term, n FROM c ORDER BY n DESC, first LIMIT 12""")
def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest terms; equally common ones in the order in which they appear."""
    return analytics.top_terms(read(spark, sf_dir, "documents"), "text", order="doc_id")


@query(f"""WITH l AS (SELECT p_brand, p_partkey, regexp_extract_all(lower(p_name || ' ' || p_type), '[a-z][a-z-]{{3,}}') AS words FROM part), t AS (SELECT p_brand, p_partkey, unnest(words) AS term, unnest(range(len(words))) AS pos FROM l),
c AS (SELECT p_brand, term, count(*) AS n, min((p_partkey, pos)) AS first FROM t WHERE term NOT IN ({_list(STOP_WORDS)}) GROUP BY ALL)
SELECT p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, first) AS INTEGER) AS rank, term, n FROM c QUALIFY rank <= 4""")
def top_terms_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest terms of each brand, equally common ones by first appearance."""
    notes = read(spark, sf_dir, "part").select("p_brand", "p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return analytics.top_terms_of(notes, ["p_brand"], "text", "p_partkey", 4)


_FACETS = {"event_type": "nullif(event_type, 'view')", "day": "strftime(ts, '%Y-%m-%d')", "user": "CAST(user_id % 5 AS VARCHAR)"}


@query(" UNION ALL ".join(f"SELECT '{name}' AS facet, {value} AS value, count(*) AS n FROM events GROUP BY 2" for name, value in _FACETS.items()))
def facet_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of several columns with their counts, null among them, in one pass."""
    rows = read(spark, sf_dir, "events").select(F.nullif("event_type", F.lit("view")).alias("event_type"), F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.col("user_id") % 5).alias("user"))
    return analytics.facets(rows, list(_FACETS))


def _skill_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).join(runs(spark, sf_dir).filter("skill_version IS NOT NULL"), "run_id")


_DIGEST = f"""digests AS (SELECT skill_version, count(*) AS reviews_aggregated, {mean_sql("hgrs")} AS mean_hgrs,
  {', '.join(f'{mean_sql(c, 2)} AS mean_{c}' for c in CRITERIA)}, {ratio_sql("100 * " + _COUNT.format("would_try_it = 'yes'"), "count(*)", 1)} AS would_try_yes_pct
  FROM reviews JOIN runs USING (run_id) WHERE skill_version IS NOT NULL GROUP BY skill_version)"""


@query(f"WITH {RUNS}, {REVIEWS}, {_DIGEST} SELECT * FROM digests")
def digest_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.digest(_skill_reviews(spark, sf_dir), ["skill_version"])


@query(f"""WITH {RUNS}, {REVIEWS}, {_DIGEST}, long AS ({' UNION ALL '.join(f"SELECT skill_version, '{c}' AS criterion, {i} AS place, mean_{c} AS mean FROM digests" for i, c in enumerate(CRITERIA))})
SELECT skill_version, CAST(row_number() OVER (PARTITION BY skill_version ORDER BY mean, place) AS INTEGER) AS rank, criterion, mean FROM long WHERE mean < 3.5""")
def weak_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.weak_criteria(analytics.digest(_skill_reviews(spark, sf_dir), ["skill_version"]), ["skill_version"])


_SCORED = f"""scored AS (SELECT skill_version AS version, CASE WHEN status <> 'ok' THEN 'failed_run_floor' WHEN hgrs IS NOT NULL THEN 'human_review' ELSE 'deterministic_proxy' END AS source,
  CASE WHEN status <> 'ok' THEN 1.0 WHEN hgrs IS NOT NULL THEN hgrs ELSE 2.5 END AS score, CASE WHEN status <> 'ok' THEN 1 WHEN hgrs IS NOT NULL THEN evidence_grounding ELSE 2 END AS grounding,
  status = 'ok' AND critical_hallucination AS hallucinated FROM runs LEFT JOIN latest USING (run_id) WHERE skill_version IS NOT NULL),
summary AS (SELECT version, count(*) AS n_scored, count(*) FILTER (WHERE source = 'failed_run_floor') AS n_failed, {mean_sql('score')} AS mean_hgrs, {mean_sql('grounding')} AS mean_grounding,
  count(*) FILTER (WHERE hallucinated) AS critical_hallucinations, array_to_string(list_sort(list(DISTINCT source)), '|') AS score_sources FROM scored GROUP BY version)"""


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = analytics.latest_reviews(reviews(spark, sf_dir), review_order()).select("run_id", "hgrs", "evidence_grounding")
    every = runs(spark, sf_dir).filter("skill_version IS NOT NULL").join(last, "run_id", "left").withColumns({"version": F.col("skill_version"), "suggested_hgrs": F.lit(2.5), "suggested_grounding": F.lit(2)})
    return analytics.version_summary(analytics.run_scores(every))


@query(f"WITH {RUNS}, {REVIEWS}, {LATEST}, {_SCORED} SELECT * FROM summary")
def validation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _summaries(spark, sf_dir).withColumn("score_sources", F.array_join("score_sources", "|"))


@query(f"""WITH {RUNS}, {REVIEWS}, {LATEST}, {_SCORED}, g AS (SELECT (CAST(round(max(mean_hgrs) FILTER (WHERE version = 'v1') * 1000) AS BIGINT) - CAST(round(max(mean_hgrs) FILTER (WHERE version = 'v0') * 1000) AS BIGINT)) / 1000 AS improvement,
  (CAST(round(max(mean_grounding) FILTER (WHERE version = 'v1') * 1000) AS BIGINT) - CAST(round(max(mean_grounding) FILTER (WHERE version = 'v0') * 1000) AS BIGINT)) / 1000 AS grounding_delta, max(critical_hallucinations) FILTER (WHERE version = 'v1') AS candidate_hallucinations FROM summary)
SELECT *, improvement >= 0.10 AND NOT grounding_delta < 0 AND candidate_hallucinations = 0 AS passed FROM g""")
def validation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.gate(_summaries(spark, sf_dir), "v0", "v1")


@query(f"WITH {REVIEWS} SELECT hgrs, count(*) AS n FROM reviews GROUP BY hgrs")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).groupBy("hgrs").agg(F.count("*").alias("n")).orderBy("hgrs")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def count_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE quality = 1) AS good, count(*) FILTER (WHERE toxic = 1) AS toxic FROM labels")
def conditional_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "labels").agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("orders", "lineitem", "documents", "events")))
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda t: read(spark, sf_dir, t).agg(F.lit(t).alias("name"), F.count("*").alias("n"))
    return one("orders").unionByName(one("lineitem")).unionByName(one("documents")).unionByName(one("events"))


#: A taxonomy for part types, with synonyms inside words, to show that priority decides.
PART_TAXONOMY = (("economy_part", "Economy Part", "EP", ("economy", "st")), ("promo_part", "Promo Part", "PP", ("promo", "pr")), ("large_part", "Large Part", "LP", ("large",)))


@query("""WITH n AS (SELECT DISTINCT p_type, trim(regexp_replace(lower(p_type), '[^a-z0-9 ]+', ' ', 'g')) AS norm FROM part)
SELECT p_type, CASE WHEN contains(norm, 'economy') OR contains(norm, 'st') THEN 'economy_part' WHEN contains(norm, 'promo') OR contains(norm, 'pr') THEN 'promo_part' WHEN contains(norm, 'large') THEN 'large_part' ELSE 'custom_tool_smell' END AS smell_key,
       CASE WHEN contains(norm, 'economy') OR contains(norm, 'st') THEN 'EP' WHEN contains(norm, 'promo') OR contains(norm, 'pr') THEN 'PP' WHEN contains(norm, 'large') THEN 'LP' ELSE 'XX' END AS code FROM n""")
def canonical_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = read(spark, sf_dir, "part").select("p_type").distinct()
    return types.withColumn("s", text.canonical_smell(F.col("p_type"), PART_TAXONOMY)).select("p_type", "s.smell_key", "s.code")


#: Names of categories: the keys and texts of documents' sources and the parts' own names with their size, each a category of its own.
_MANY_NAMES = "names AS (SELECT CAST(p_partkey AS INTEGER) AS priority, 'cat_' || p_partkey AS smell_key, 'C' || p_partkey % 97 AS code, unnest(['size ' || p_size || ' of ' || p_partkey % 40, lower(p_name) || ' ' || p_size, lower(p_type) || ' ' || p_partkey % 300, 'x' || p_partkey, 'y' || p_partkey * 7]) AS synonym FROM part)"


@query(f"""WITH {_MANY_NAMES}, labels AS (SELECT p_partkey, trim(lower(p_name || ' ' || p_size || ' ' || p_type || ' ' || p_partkey % 500)) AS norm FROM part),
hits AS (SELECT p_partkey, min(priority) AS priority FROM labels JOIN names ON contains(norm, synonym) GROUP BY 1)
SELECT p_partkey, coalesce('cat_' || priority, 'custom_tool_smell') AS smell_key, coalesce('C' || priority % 97, 'XX') AS code FROM labels LEFT JOIN hits USING (p_partkey)""")
def many_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by a taxonomy of five times as many names as there are parts: the first category that has a name in the label."""
    part, text_of = read(spark, sf_dir, "part"), lambda *c: F.concat(*[x.cast("string") if not isinstance(x, str) else F.col(x).cast("string") for x in c])
    key, size, gap = F.col("p_partkey"), F.col("p_size"), F.lit(" ")
    names = F.array(text_of(F.lit("size "), size, F.lit(" of "), key % 40), text_of(F.lower("p_name"), gap, size), text_of(F.lower("p_type"), gap, key % 300), text_of(F.lit("x"), key), text_of(F.lit("y"), key * 7))
    rows = part.select(key.cast("int").alias("priority"), text_of(F.lit("cat_"), key).alias("smell_key"), F.lit("Category").alias("smell_type"), text_of(F.lit("C"), key % 97).alias("code"), F.explode(names).alias("synonym"))
    labels = part.select("p_partkey", text_of("p_name", gap, size, gap, "p_type", gap, key % 500).alias("label"))
    return naming.canonical_labels(labels, rows).select("p_partkey", "smell_key", "code")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem""")
def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers for all lines in order, by ranges and the counts before them."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return numbering.number_rows(read(spark, sf_dir, "lineitem").select(*keys), [F.col(k) for k in keys]).select(*keys[:3], "n")


@query("""SELECT p_partkey, array_to_string(list_filter([trim(p_brand), trim(p_name), trim(p_type)], lambda x: x <> ''), '/') AS components,
CAST(len(list_distinct(list_filter([trim(p_brand), trim(p_name), trim(p_type)], lambda x: x <> ''))) AS INTEGER) AS n FROM part""")
def split_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = F.concat(F.lit("["), F.concat_ws(" ; ", F.col("p_brand"), F.concat(F.lit("'"), F.col("p_name"), F.lit("'")), F.col("p_type")), F.lit("]"))
    parts = text.split_components(listed)
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(parts, "/").alias("components"), F.size(parts).alias("n"))


@query(f"""SELECT event_id, CAST(props ->> '$.k' AS INTEGER) AS k, len(list_filter(['k', 'event_type'], lambda x: x NOT IN ({_list(PROVENANCE)}))) AS n_attributes FROM events""")
def json_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    props = F.from_json("props", "map<string,string>")
    named = F.map_concat(props, F.create_map(F.lit("Event Type"), F.col("event_type"), F.lit("Tool"), F.lit("x"), F.lit("empty"), F.lit("")))
    clean = normalize.clean_attributes(named)
    return read(spark, sf_dir, "events").select("event_id", F.element_at(clean, "k").cast("int").alias("k"), F.size(clean).cast("long").alias("n_attributes"))


@query("SELECT event_id, props AS extracted FROM events")
def extract_json_noisy(spark: SparkSession, sf_dir: str) -> DataFrame:
    noisy = F.concat(F.lit("Here is the answer: ```json\n"), F.col("props"), F.lit("\n``` and { more"))
    return read(spark, sf_dir, "events").select("event_id", noisy_json.extract_json(noisy).alias("extracted"))


@query("SELECT doc_id, CAST(greatest(1, length(coalesce(text, '')) // 4) AS INTEGER) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


_HITS = " + ".join(f"CAST(contains(lower(coalesce(text, '')), '{t}') AS INTEGER)" for t in RATIONALE_TERMS)


@query(f"""WITH d AS (SELECT doc_id, {_HITS} AS hits, length(text) AS chars, doc_id % 4 AS risks, doc_id % 2 AS questions, doc_id % 9 AS steps, doc_id % 3 <> 0 AS grounded FROM documents)
SELECT doc_id, NOT grounded AS critical_hallucination, CASE WHEN NOT grounded THEN 1 ELSE 5 END AS evidence_grounding, CASE WHEN doc_id % 5 = 0 THEN 3 WHEN doc_id % 5 = 1 THEN 4 ELSE 1 END AS refactoring_relevance,
 1 + CAST(hits >= 2 AS INTEGER) + CAST(hits >= 4 AND chars > 200 AS INTEGER) AS architectural_reasoning,
 1 + CAST(risks >= 1 AS INTEGER) + CAST(risks >= 2 OR questions > 0 AS INTEGER) + CAST(steps BETWEEN 3 AND 7 AS INTEGER) AS minimality_and_safety,
 CAST(1 + CASE WHEN steps >= 3 THEN 2 ELSE 0 END + CAST(steps >= 2 AS INTEGER) AS INTEGER) AS actionability FROM d""")
def structural_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, repeat = F.col("doc_id"), lambda value, n: F.array_repeat(F.lit(value), n.cast("int"))
    df = read(spark, sf_dir, "documents").select(
        "doc_id", F.lit("god_component").alias("smell_key"), F.array(F.lit("E1"), F.lit("E2")).alias("evidence_ids"), F.array(F.lit("org.a"), F.lit("org.b")).alias("components"), F.array(F.lit("org.a->org.b")).alias("edges"),
        F.when(doc % 3 == 0, F.array(F.lit("E9"))).otherwise(F.array(F.lit("E1"))).alias("evidence_used"), F.array(F.lit("org.a")).alias("suggested_components"),
        F.array(F.lit("org.a"), F.lit("org.b")).alias("boundary"), F.lit("supported_by_evidence").alias("direction"),
        F.when(doc % 5 == 0, "Other").when(doc % 5 == 1, "Split Component").otherwise("Facade").alias("recommended"), F.col("text").alias("rationale"),
        repeat("risk", doc % 4).alias("risks"), repeat("question", doc % 2).alias("questions"), repeat("Move the class out of org.a", doc % 9).alias("steps"), F.lit(2).alias("cost_efficiency"),
    )
    return scoring.structural_checks(df).select("doc_id", "critical_hallucination", *CRITERIA[:5])


@query("SELECT d.doc_id, l.doc_id IS NOT NULL AS reviewed FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def unreviewed_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.existing_first(read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels"), "doc_id").orderBy("reviewed", "doc_id")


@query("""SELECT event_id, event_type, props FROM events WHERE event_type IN ('click', 'error') AND contains(lower(concat_ws(' ', event_type, props, user_id)), '"k": 1') ORDER BY ts DESC, event_id DESC LIMIT 25""")
def activity_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = latest.search(latest.matching(read(spark, sf_dir, "events"), event_type=["click", "error"]), '"k": 1', ["event_type", "props", "user_id"])
    return found.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(25).select("event_id", "event_type", "props")


@query(f"WITH {RUNS} SELECT run_id, project, created_at FROM runs WHERE project IN ('p1', 'p2') AND status = 'ok' AND skill_version = 'v1'")
def run_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.matching(runs(spark, sf_dir), project=["p1", "p2"], status="ok", skill_version="v1", agent_mode=None).select("run_id", "project", "created_at")


@query(f"WITH {RUNS} SELECT run_id, project, total_tokens FROM runs WHERE project = 'p3' OR run_id = 7")
def project_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).filter((F.col("project") == "p3") | (F.col("run_id") == 7)).select("run_id", "project", "total_tokens")


@query(f"WITH {RUNS}, {REVIEWS} SELECT run_id, hgrs, c_custkey AS case_id, run_id % 4 = 0 AS human_edited FROM reviews JOIN runs USING (run_id) JOIN customer ON c_custkey = case_id WHERE status = 'ok' AND hgrs >= 4")
def export_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.to_json(F.struct("c_name", "c_mktsegment")).alias("case_json"))
    made = runs(spark, sf_dir).withColumn("suggestion_json", F.to_json(F.struct("run_id")))
    rated = reviews(spark, sf_dir).withColumn("edited_output_json", F.when(F.col("run_id") % 4 == 0, "{}"))
    return exporting.examples(rated, made, cases).select("run_id", "hgrs", "case_id", "human_edited")


@query("""SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id", "ts")
    base, changes = rows.filter("event_id % 2 = 0"), rows
    merged = latest.upsert(latest.latest(base, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]), changes, ["user_id", "event_type"], [F.col("ts"), F.col("event_id")])
    return merged.select("user_id", "event_type", "value", "event_id")


@query("SELECT event_id, ts, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def audit_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(200)


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest.missing_parents(read(spark, sf_dir, "documents").select("doc_id"), "doc_id", read(spark, sf_dir, "labels"), "doc_id")


@query("SELECT o_orderkey AS run_id, sum(l_quantity) AS prompt_tokens, CAST(sum(l_linenumber) AS BIGINT) AS completion_tokens, CAST(sum(CAST(round(l_tax * 1000) AS BIGINT)) AS DOUBLE) / 1000 AS runtime_seconds FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_quantity").alias("prompt_tokens"), F.col("l_linenumber").alias("completion_tokens"), F.col("l_tax").alias("runtime_seconds"))
    return analytics.usage_totals(calls)


@query(f"WITH {RUNS} SELECT m.model_id, a.agent_mode, v.skill_version FROM (SELECT DISTINCT model_id FROM runs) m, (SELECT DISTINCT agent_mode FROM runs) a, (SELECT DISTINCT skill_version FROM runs WHERE skill_version IS NOT NULL) v")
def experiment_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir)
    return analytics.experiment_grid(r.select("model_id").distinct(), r.select("agent_mode").distinct(), r.select("skill_version").filter("skill_version IS NOT NULL").distinct())


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'not backed: unknown evidence ids: ' || user_id WHEN event_type = 'view' THEN 'none' ELSE 'backed' END AS banner FROM events")
def review_banner(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when(F.col("event_type") == "error", F.array(F.col("user_id").cast("string"))).otherwise(F.array().cast("array<string>"))
    critical = F.when(F.col("event_type") != "view", F.col("event_type") == "error")
    return read(spark, sf_dir, "events").select("event_id", scoring.banner(critical, bad, F.array().cast("array<string>")).alias("banner"))


@query("SELECT p_partkey, 'v' || (p_size + 1) AS next FROM part")
def version_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", text.next_version(F.concat(F.lit("v"), F.col("p_size").cast("string"))).alias("next"))


def queries() -> dict[str, Query]:
    from brindle.plans import files  # noqa: F401 registers its queries here

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
