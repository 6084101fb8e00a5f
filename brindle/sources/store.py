"""The evidence store: append-only Parquet tables with latest-wins views.

Parquet tables know no MERGE, so a change is an appended row, which may hold
just the key and what changes. `current` folds a table's rows by its key: of each
column the last value that isn't null wins, but for columns that keep their first
one. A key's rows are sorted once and read from the last one back, so rows are
shuffled as they are, however many columns are folded. A key is removed by a row that says so, and
later rows begin it anew.

What belongs to projects lies in partitions by project, so that one project is
read, folded, rewritten or cleared without touching the files of others.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.vocab import CRITERIA
from brindle.session import COMPRESSION, discard, written


@dataclass(frozen=True)
class Table:
    """schema without the two columns that every table has; key: of the latest-wins view; first: columns that keep their first value; by: partition columns."""

    schema: str
    key: tuple[str, ...]
    first: tuple[str, ...] = ()
    by: tuple[str, ...] = ()


TABLES = {
    "projects": Table("project string, path string, architecture_type string, component_type string, source_revision string", ("project",), ("path", "architecture_type", "component_type", "source_revision")),
    "tool_runs": Table("run_id string, project string, tool string, mode string, source_path string, source_hash string, status string, error string, edges_end long", ("run_id",), by=("project",)),
    "raw_findings": Table("run_id string, project string, tool string, kind string, source_file string, row_no long, record_json string", ("run_id", "kind", "row_no", "source_file"), by=("project", "kind")),
    "graph_edges": Table("run_id string, project string, evidence_id string, from_component string, to_component string, relation_type string, confidence double, source string, weight double, weight_json string", ("project", "evidence_id"), by=("project",)),
    "evidence_cases": Table("case_id string, project string, smell_id string, smell_key string, case_json string, split string", ("case_id",), by=("project",)),
    "skills": Table("name string, version string, file_path string, text string, status string, parent_version string, notes string", ("name", "version"), ("parent_version",)),
    "agent_runs": Table(
        "run_id string, project string, case_id string, smell_id string, agent_mode string, provider string, model_id string, skill_name string, skill_version string, experiment_id string, status string, error string,"
        " raw_response string, suggestion_json string, checks_json string, repair_attempted boolean, prompt_tokens long, completion_tokens long, total_tokens long, runtime_seconds double",
        ("run_id",),
        by=("project",),
    ),
    "model_calls": Table("call_key string, model_id string, answer string, failure string, prompt_tokens long, completion_tokens long, runtime_seconds double", ("call_key",)),
    "malformed_outputs": Table("run_id string, raw_text string, error string", ("run_id",)),
    "suggested_scores": Table("run_id string, source string, scores_json string", ("run_id", "source")),
    "reviews": Table("review_id string, run_id string, reviewer string, " + ", ".join(f"{c} int" for c in CRITERIA) + ", hgrs double, decision string, would_try_it string, reviewer_notes string, edited_output_json string", ("review_id",)),
    "feedback_digests": Table("digest_id string, skill_name string, skill_version string, digest_json string", ("digest_id",)),
    "validation_reports": Table("report_id string, skill_name string, baseline_version string, candidate_version string, report_json string, passed boolean, human_approved boolean, promoted boolean", ("report_id",)),
    "experiments": Table("experiment_id string, name string, config_json string", ("experiment_id",)),
    "audit_log": Table("entity_type string, entity_id string, action string, actor string, details_json string", ("entry_id",)),
}
#: Projects that a plan names one by one, at most.
NAMED_PROJECTS = 200
#: When a row was written, an id that orders rows of one instant, and whether the row takes its key away.
STAMPS = "written_at timestamp, entry_id string, removed boolean"
#: When a folded row's key began.
BEGAN = T.StructField("first_at", T.TimestampType())


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(f"{TABLES[name].schema}, {STAMPS}")


def _shaped(df: DataFrame, name: str) -> DataFrame:
    columns = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in [*schema_of(name), BEGAN]]
    return df.select(*columns)


def append(df: DataFrame, root: str, name: str) -> None:
    """Add rows to a table; columns that `df` lacks are null, others are left out."""
    stamped = df.withColumns({"written_at": F.current_timestamp(), "entry_id": F.expr("uuid()")})
    writer = _shaped(stamped, name).write.mode("append").option("compression", COMPRESSION)
    writer = writer.partitionBy(*TABLES[name].by) if TABLES[name].by else writer
    writer.parquet(f"{root}/{name}")


def _partitioned(name: str) -> None:
    if "project" not in TABLES[name].by:
        raise ValueError(f"{name} has no partitions by project")


def replace(df: DataFrame, root: str, name: str, project: str) -> None:
    """Put `df` in the place of all that a project's partitions of a table hold; other projects' files stay. Without rows nothing is replaced."""
    _partitioned(name)
    rows = written(_shaped(df.withColumn("project", F.lit(project)), name), f"replace-{name}")  # it may be read from the files that go
    rows.write.mode("overwrite").option("compression", COMPRESSION).option("partitionOverwriteMode", "dynamic").partitionBy(*TABLES[name].by).parquet(f"{root}/{name}")
    discard(rows)


def compact(spark: SparkSession, root: str, name: str, project: str) -> None:
    """Fold a project's rows of a table into one row a key. What is current stays the same."""
    replace(current(spark, root, name, project).withColumn("first_at", F.col("created_at")), root, name, project)


def append_row(spark: SparkSession, root: str, table: str, /, **values) -> None:
    kind = T.StructType([f for f in schema_of(table) if f.name in values])
    append(spark.createDataFrame([tuple(values[f.name] for f in kind)], kind), root, table)


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All rows of a table; none where nothing was written yet."""
    schema = T.StructType([*schema_of(name), BEGAN])
    try:
        return spark.read.schema(schema).parquet(f"{root}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        # a plan without rows; an empty list would go through Python workers, which take seconds to start
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])


def current(spark: SparkSession, root: str, name: str, project: str | list[str] | None = None) -> DataFrame:
    """One row per key: of each column the last value that isn't null, or the first one where the table keeps that.

    `created_at` is when the key's first row was written, `written_at` when its
    last was. Rows up to the last removal of a key don't count. With a project,
    or several, only their partitions are read, and that of changes that name no project.
    """
    rows = read(spark, root, name)
    if project is None:
        return folded(rows, name)
    _partitioned(name)
    own = F.col("project").isin([project] if isinstance(project, str) else project)
    return folded(rows.filter(own | F.col("project").isNull()), name).filter(own)


def folded(rows: DataFrame, name: str) -> DataFrame:
    """Rows of a table as `current` has them: one row per key."""
    table, columns = TABLES[name], [c for c in schema_of(name).names if c != "removed"]
    gone = F.coalesce("removed", F.lit(False))
    began = F.coalesce("first_at", "written_at")
    if table.key == ("entry_id",):  # every row is its own
        return rows.filter(~gone).select(*columns, began.alias("created_at"))
    # from a key's last row back to its first: one shuffle and one sort, whatever the number of columns
    ordered = Window.partitionBy(*table.key).orderBy(F.col("written_at").desc(), F.col("entry_id").desc())
    back = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    left = rows.withColumn("_gone", F.max(gone).over(back)).filter(~F.col("_gone"))
    value = lambda c: (F.last if c in table.first else F.first)(c, ignorenulls=True).over(back).alias(c)
    oldest = F.lead(F.lit(True)).over(ordered).isNull()
    whole = left.select(*[F.col(c) if c in table.key else value(c) for c in columns], F.min(began).over(back).alias("created_at"), oldest.alias("_oldest"))
    return whole.filter("_oldest").drop("_oldest")


def projects_of(df: DataFrame) -> list[str] | None:
    """The projects that rows name, as `current` takes them; null, for all of them, where they are more than `NAMED_PROJECTS`."""
    names = [r[0] for r in df.select("project").filter("project IS NOT NULL").distinct().limit(NAMED_PROJECTS + 1).collect()]
    return names if len(names) <= NAMED_PROJECTS else None


def audit(spark: SparkSession, root: str, entity_type: str, entity_id: str, action: str, actor: str = "system", details_json: str = "{}") -> None:
    append_row(spark, root, "audit_log", entity_type=entity_type, entity_id=entity_id, action=action, actor=actor, details_json=details_json)


def add_projects(df: DataFrame, root: str) -> None:
    """Add the projects that aren't there yet; those that are stay as they were."""
    known = current(df.sparkSession, root, "projects").select("project")
    append(df.dropDuplicates(["project"]).join(known, "project", "left_anti"), root, "projects")


def assign(cases: DataFrame, root: str) -> None:
    """Set the split of cases (case_id, split) that are in the store; where they have a project, only those are read."""
    own = projects_of(cases) if "project" in cases.columns else None
    known = current(cases.sparkSession, root, "evidence_cases", own).select("case_id", "project")
    append(cases.select("case_id", "split").join(known, "case_id"), root, "evidence_cases")


def clear_cases(spark: SparkSession, root: str, project: str) -> None:
    """Take a project's cases away: its partition keeps one row a case, which says so."""
    own = current(spark, root, "evidence_cases", project).select("case_id", F.lit(True).alias("removed"), F.current_timestamp().alias("written_at"), F.expr("uuid()").alias("entry_id"))
    replace(own, root, "evidence_cases", project)
