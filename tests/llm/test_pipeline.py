"""The five stages on the smallest tables, each against what it should keep."""

import pytest

import corpus_pipeline
from brindle.llm import mixing, packing, toxicity
from brindle.llm.common import table
from brindle.llm.queries import tokenizer_path
from tests.conftest import SMALL
from tests.llm.helpers import documents, rows_of
from tests.llm.test_exact_dedup import brute as exact
from tests.llm.test_mixing import brute as mixture
from tests.llm.test_ngram_join import brute as near
from tests.llm.test_packing import brute_pieces, check_sequences

needs_tables = pytest.mark.skipif(not SMALL.exists(), reason="no test tables here")


@needs_tables
def test_stages(spark):
    sf_dir = str(SMALL)
    docs = table(spark, sf_dir, "documents")
    before = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    frames = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        frames.append(docs)
    assert all(f.columns == table(spark, sf_dir, "documents").columns for f in frames[:-1])

    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    scores = {r.doc_id: r.predicted for r in toxicity.score(table(spark, sf_dir, "documents"), model).collect()}
    rows = [r for r in before if not scores[r[0]]]
    assert rows_of(frames[0], "doc_id", "text") == sorted(r[:2] for r in rows)
    assert rows  # 87 labels show no significant word; the next test has more

    stay = {i for i, _, _, kept, _ in exact([r[:2] for r in rows]) if kept}
    rows = [r for r in rows if r[0] in stay]
    assert {r.doc_id for r in frames[1].collect()} == stay

    stay = {i for i, _, c in near([r[:2] for r in rows]) if i == c}
    rows = [r for r in rows if r[0] in stay]
    assert {r.doc_id for r in frames[2].collect()} == stay

    drawn = [tuple(r) for r in frames[3].select("doc_id", "text").collect()]
    assert sorted(i for i, *_ in drawn) == sorted(r[0] for r in mixture(rows))
    assert sum(len(t.split()) for _, t in drawn) == sum(r[-1] for r in mixture(rows))

    packed = frames[4].collect()
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed), key=str) == brute_pieces(drawn)
    check_sequences(packed)


@needs_tables
def test_toxic_documents_go(spark):
    """At the next size documents are rejected, most of them labelled toxic, and no labelled clean one but one at most."""
    sf_dir = str(SMALL.parent / "sf0.01")
    docs, labels = table(spark, sf_dir, "documents"), {r.doc_id: r.toxic for r in table(spark, sf_dir, "labels").collect()}
    every = {r.doc_id for r in docs.select("doc_id").collect()}
    kept = {r.doc_id for r in corpus_pipeline.STAGES[0][1](spark, docs, sf_dir).select("doc_id").collect()}
    gone = every - kept
    assert 0 < len(kept) < len(every)
    assert sum(labels.get(i) == 1 for i in gone) > 0.8 * sum(labels.values())
    assert sum(labels.get(i) == 0 for i in gone) <= 1


@needs_tables
def test_run_applies_all_stages(spark):
    got = corpus_pipeline.run(spark, str(SMALL))
    assert got.columns == packing.pack(table(spark, str(SMALL), "documents"), tokenizer_path("word_bpe_49k.json")).columns
    assert got.count() > 0


@pytest.mark.parametrize("rows", [[], [(None, None, None, None), (1, "", "en", "src0"), (1, "", "en", "src0")]])
def test_small_tables(spark, tmp_path, rows):
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_mixing_keeps_columns(spark):
    docs = documents(spark, [(1, "a b c", "en", "src0")], clashing=True)
    assert mixing.mixed_documents(docs).columns == docs.columns
