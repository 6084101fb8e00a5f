"""Reviewed runs as training examples, and their files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions.vocab import CRITERIA, INSTRUCTION

_ALL = {"ignoreNullFields": "false"}


def examples(reviews: DataFrame, runs: DataFrame, cases: DataFrame, least: float = 4.0) -> DataFrame:
    """Reviews of ok runs with a score of at least `least`, their case and the preferred output: the reviewer's edit if there is one."""
    kept = reviews.filter(F.col("hgrs") >= least)
    joined = kept.join(runs.filter("status = 'ok'"), "run_id").join(cases, "case_id")
    edited = F.nullif(F.col("edited_output_json"), F.lit(""))
    return joined.withColumns({"preferred_output": F.coalesce(edited, "suggestion_json"), "human_edited": edited.isNotNull()})


def instruction_lines(df: DataFrame) -> DataFrame:
    """value: one JSON object per example; the case is a JSON string in it."""
    meta = F.struct("run_id", "skill_version", "agent_mode", "model_id", "hgrs", "decision", "would_try_it", "human_edited", F.struct(*CRITERIA).alias("criteria"), F.coalesce("reviewer_notes", F.lit("")).alias("reviewer_notes"))
    return df.select(F.to_json(F.struct(F.lit(INSTRUCTION).alias("instruction"), F.col("case_json").alias("input"), F.col("preferred_output").alias("output"), meta.alias("meta")), _ALL).alias("value"))


def chat_lines(df: DataFrame) -> DataFrame:
    """value: one JSON object per example with a system, a user and an assistant message."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    messages = F.array(message("system", F.lit(INSTRUCTION)), message("user", F.col("case_json")), message("assistant", F.col("preferred_output")))
    return df.select(F.to_json(F.struct(messages.alias("messages"), F.struct("hgrs", "run_id", "skill_version", "human_edited").alias("meta")), _ALL).alias("value"))


def review_table(df: DataFrame) -> DataFrame:
    return df.select("run_id", "agent_mode", "model_id", "skill_version", *CRITERIA, "hgrs", "decision", "would_try_it", "human_edited", F.coalesce("reviewer_notes", F.lit("")).alias("reviewer_notes"))


def export(df: DataFrame, folder: str, formats: tuple[str, ...] = ("instruction", "chat", "csv")) -> dict[str, str]:
    """Write the chosen formats below `folder`; returns the paths."""
    out = {}
    if "instruction" in formats:
        instruction_lines(df).write.text(out.setdefault("instruction", f"{folder}/instruction_dataset"))
    if "chat" in formats:
        chat_lines(df).write.text(out.setdefault("chat", f"{folder}/chat_dataset"))
    if "csv" in formats:
        review_table(df).write.csv(out.setdefault("csv", f"{folder}/review_dataset"), header=True)
    return out
