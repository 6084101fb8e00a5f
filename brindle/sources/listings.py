"""Lists of what the store holds, the newest first, and the values to choose from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.analytics import facets
from brindle.operators.latest import matching, search
from brindle.sources import store

#: By table: what breaks ties of time, and columns that are told apart in lists to choose from.
LISTS = {
    "projects": (("project",), ("architecture_type", "component_type")),
    "tool_runs": (("run_id",), ("tool", "mode", "status")),
    "evidence_cases": (("project", "smell_id"), ("smell_key", "split")),
    "skills": (("name", "version"), ("name", "status")),
    "agent_runs": (("run_id",), ("agent_mode", "model_id", "skill_version", "status")),
    "reviews": (("review_id",), ("reviewer", "decision", "would_try_it")),
    "feedback_digests": (("digest_id",), ("skill_name", "skill_version")),
    "validation_reports": (("report_id",), ("skill_name", "passed", "promoted")),
    "experiments": (("experiment_id",), ("name",)),
    "audit_log": (("entry_id",), ("entity_type", "action", "actor")),
}


def listing(spark: SparkSession, root: str, name: str, project: str | None = None, most: int | None = None, text: str | None = None, **equal) -> DataFrame:
    """What is current in a table: of a project, with equal values (as `latest.matching` takes them) and with a text in any text column.

    Cases are in order of project and smell_id, everything else by time, the
    newest first. `most` rows are a sorted list's first ones, so no full sort is needed.
    """
    ties, _ = LISTS[name]
    by_project = project if "project" in store.TABLES[name].by else None
    rows = matching(store.current(spark, root, name, by_project), **equal)
    if project is not None and by_project is None:
        rows = rows.filter(F.col("project") == project)
    if text:
        rows = search(rows, text, [f.name for f in rows.schema if f.dataType.simpleString() == "string"])
    order = [F.col(c) for c in ties] if name == "evidence_cases" else [F.col("created_at").desc(), *[F.col(c).desc() for c in ties]]
    ordered = rows.orderBy(*order)
    return ordered.limit(most) if most else ordered


def choices(spark: SparkSession, root: str, name: str, project: str | None = None) -> DataFrame:
    """facet, value, n of the columns by which a table's list is narrowed."""
    return facets(store.current(spark, root, name, project if "project" in store.TABLES[name].by else None), list(LISTS[name][1]))
