"""Columns of any name and type pass the operators that return whole rows."""

import pytest
from pyspark.sql import functions as F

from brindle.llm import exact_dedup, mixing, ngram_join
from tests.llm.helpers import documents

NAMES = ("_n", "_sha", "_used", "_all", "_row", "_keep_id", "row", "n", "id", "sha", "chars", "keep", "tokens", "domain", "used_tokens", "key", "bucket", "a.b")


@pytest.mark.parametrize("operator", [exact_dedup.drop_copies, ngram_join.distinct_documents, mixing.mixed_documents])
def test_rows_come_back_whole(spark, operator):
    base = documents(spark, [(1, "one two three four five six"), (2, "seven eight"), (None, "nine"), (None, None), (3, "")])
    wide = base.withColumns({name: F.concat(F.lit(f"{name}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for name in NAMES})
    wide = wide.withColumn("map", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("v", F.parse_json(F.lit('{"x": [1]}')))
    got = operator(wide)
    assert got.columns == wide.columns
    rows = got.collect()
    assert {r.doc_id for r in rows} >= {1, 2}
    for r in rows:
        own = "none" if r.doc_id is None else str(r.doc_id)
        assert all(r[name] == f"{name}-{own}" for name in NAMES) and r["map"] == {"k": r.doc_id}
