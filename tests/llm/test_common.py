"""What workers keep between tasks."""

import pyarrow as pa
import pytest

from brindle.llm import common, ngram_join, packing
from brindle.llm.queries import tokenizer_path
from tests.llm.helpers import documents


@pytest.mark.parametrize("sizes", [[], [3], [2, 0, 5]])
def test_lean_changes_no_batch(monkeypatch, sizes):
    trims = []
    monkeypatch.setattr(common, "trim", lambda: trims.append(1))
    batches = [pa.record_batch({"x": list(range(n))}, pa.schema([("x", pa.int64())])) for n in sizes]
    out = list(common.lean(lambda given: (b for b in given))(iter(batches)))
    assert [b.num_rows for b in out] == sizes
    assert len(trims) == len(sizes) + 1


def test_trim_gives_memory_back():
    pool = pa.default_memory_pool()
    before = pool.bytes_allocated()
    data = pa.array(range(1_000_000), pa.int64())
    assert pool.bytes_allocated() > before
    del data
    common.trim()
    assert pool.bytes_allocated() == before


def test_workers_get_small_batches(spark, monkeypatch):
    """Long texts reach the packing and the sets in batches of a few megabytes, not of 10,000 rows."""

    def watched(batch, column, size):
        if batch.nbytes > 8_000_000:
            raise ValueError(f"a batch of {batch.nbytes} bytes")
        return (batch.slice(i, 1) for i in range(batch.num_rows))

    docs = documents(spark, [(i, "a bc " * 60_000) for i in range(60)]).coalesce(1)
    for module in (packing, ngram_join):
        monkeypatch.setattr(module, "slices", watched)
    assert packing.pieces(docs, tokenizer_path("word_bpe_49k.json")).select("doc_id").distinct().count() == 60
    assert ngram_join._mapped(docs, ["doc_id"], lambda part, sets: [part.column(1), pa.array(map(len, sets), pa.int64())], "doc_id long, n long").count() == 60


def test_limits_of_the_session_stay(spark):
    before = spark.conf.get(common.BATCH_SETTING, None)
    try:
        spark.conf.set(common.BATCH_SETTING, "12345")
        common.in_small_batches(spark.range(1))
        assert spark.conf.get(common.BATCH_SETTING) == "12345"
    finally:
        spark.conf.unset(common.BATCH_SETTING) if before is None else spark.conf.set(common.BATCH_SETTING, before)
