"""Review data as views over the standard tables, each once for Spark and once for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions.vocab import CRITERIA
from brindle.operators.scoring import hgrs

#: Factors of quantity, line number and part that give the seven scores.
FACTORS = ((1, 0, 0), (2, 1, 0), (1, 2, 1), (3, 1, 1), (1, 1, 2), (2, 3, 1), (1, 3, 2))
#: A review's order among those of its run: time, then every other column that can differ.
REVIEW_ORDER = ("reviewed_at", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")


def ratio_sql(numerator: str, denominator: str, places: int) -> str:
    """Whole numbers' ratio, rounded once with halves away from zero."""
    return f"CAST((CAST({numerator} AS HUGEINT) * {2 * 10**places} + {denominator}) // nullif(2 * CAST({denominator} AS HUGEINT), 0) AS DOUBLE) / {10**places}"


def mean_sql(value: str, places: int = 3) -> str:
    """The mean of values that aren't negative, from their whole thousandths."""
    return ratio_sql(f"sum(CAST(round(({value}) * 1000) AS BIGINT))", f"(count({value}) * 1000)", places)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    return o.select(
        key.alias("run_id"),
        F.concat(F.lit("p"), (F.col("o_custkey") % 20).cast("string")).alias("project"),
        F.col("o_custkey").alias("case_id"),
        F.col("o_orderpriority").alias("agent_mode"),
        F.concat(F.lit("m"), (F.col("o_custkey") % 3).cast("string")).alias("model_id"),
        F.when(key % 3 == 1, "v0").when(key % 3 == 2, "v1").alias("skill_version"),
        F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "P", "invalid_json").otherwise("error").alias("status"),
        F.when(key % 13 == 0, 0).otherwise(F.floor(F.col("o_totalprice") / 100)).cast("long").alias("total_tokens"),
        ((key % 97) * 0.5).cast("double").alias("runtime_seconds"),
        (key % 11 == 0).alias("critical_hallucination"),
        F.col("o_orderdate").alias("created_at"),
    )


RUNS = """runs AS (
  SELECT o_orderkey AS run_id, 'p' || (o_custkey % 20) AS project, o_custkey AS case_id, o_orderpriority AS agent_mode, 'm' || (o_custkey % 3) AS model_id,
         CASE o_orderkey % 3 WHEN 1 THEN 'v0' WHEN 2 THEN 'v1' END AS skill_version,
         CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'P' THEN 'invalid_json' ELSE 'error' END AS status,
         CASE WHEN o_orderkey % 13 = 0 THEN 0 ELSE CAST(floor(o_totalprice / 100) AS BIGINT) END AS total_tokens,
         CAST(o_orderkey % 97 AS DOUBLE) * 0.5 AS runtime_seconds, o_orderkey % 11 = 0 AS critical_hallucination, o_orderdate AS created_at
  FROM orders)"""


def _score(a: int, b: int, c: int) -> Column:
    columns = ((F.col("l_quantity").cast("long"), a), (F.col("l_linenumber"), b), (F.col("l_partkey"), c))
    terms = [x if n == 1 else x * n for x, n in columns if n]
    return (1 + sum(terms[1:], terms[0]) % 5).cast("int")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        *[_score(*f).alias(c) for c, f in zip(CRITERIA, FACTORS, strict=True)],
        F.when(F.col("l_returnflag") == "A", "yes").otherwise("no").alias("would_try_it"),
        F.when(F.col("l_linestatus") == "O", "accept").otherwise("revise").alias("decision"),
        F.col("l_shipdate").alias("reviewed_at"),
        "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    )
    return rows.withColumn("hgrs", hgrs())


def review_order() -> list[Column]:
    return [F.col(c) for c in REVIEW_ORDER]


_SCORES = ", ".join(f"CAST(1 + (CAST(l_quantity AS BIGINT) * {a} + l_linenumber * {b} + l_partkey * {c}) % 5 AS INTEGER) AS {name}" for name, (a, b, c) in zip(CRITERIA, FACTORS, strict=True))
_HGRS = " + ".join(f"{w} * {c}" for w, c in zip((25, 20, 15, 15, 10, 10, 5), CRITERIA, strict=True))
REVIEWS = f"""raw_reviews AS (
  SELECT l_orderkey AS run_id, {_SCORES}, CASE WHEN l_returnflag = 'A' THEN 'yes' ELSE 'no' END AS would_try_it,
         CASE WHEN l_linestatus = 'O' THEN 'accept' ELSE 'revise' END AS decision,
         l_shipdate AS reviewed_at, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem),
reviews AS (SELECT *, CAST({_HGRS} AS DOUBLE) / 100 AS hgrs FROM raw_reviews)"""
LATEST = f"""latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY {', '.join(c + ' DESC' for c in REVIEW_ORDER)}) AS rn FROM reviews) WHERE rn = 1)"""


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses between parts: from each line's part to that of lines one number on in the same order, with how many there are."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("org."), F.col("l_partkey").cast("string")).alias("part"))
    ends = lines.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("part").alias("from_component")).join(lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("n"), F.col("part").alias("to_component")), ["l_orderkey", "n"])
    return ends.filter("from_component <> to_component").groupBy("from_component", "to_component").agg(F.count("*").alias("weight"))


PART_EDGES = """named AS (
  SELECT 'org.' || a.l_partkey AS from_component, 'org.' || b.l_partkey AS to_component, count(*) AS weight FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_partkey <> b.l_partkey GROUP BY 1, 2)"""


def order_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for each order, its parts being the components, in order of name."""
    part = F.concat(F.lit("org."), F.col("l_partkey").cast("string"))
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("order_key")).agg(F.array_sort(F.collect_set(part)).alias("components"))


ORDER_CASES = "order_cases AS (SELECT l_orderkey AS order_key, list_sort(list(DISTINCT 'org.' || l_partkey)) AS components FROM lineitem GROUP BY 1)"


def supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From each line's supplier to that of lines one number on in the same order, with how many there are."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    ends = lines.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("a")).join(lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("n"), F.col("l_suppkey").alias("b")), ["l_orderkey", "n"])
    return ends.groupBy("a", "b").agg(F.count("*").alias("weight"))


SUPPLIER_EDGES = """edges AS (SELECT a.l_suppkey AS a, b.l_suppkey AS b, count(*) AS weight FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 GROUP BY 1, 2)"""


def user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings: what each user did on each day, with the types of events as components."""
    day = F.date_format("ts", "yyyy-MM-dd")
    return read(spark, sf_dir, "events").select("event_id", "user_id", day.alias("day"), "event_type", "ts", "value", "props")
