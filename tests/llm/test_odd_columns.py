"""No operator alters what it does not work on: large ids next to nulls, and columns that have its own names."""

import public_tokenizers
import pytest

import corpus_pipeline
from barloom.llm import decontaminate, line_dedup, mixing, near_dedup, pii, quality_model, quality_rules, tokens, toxicity


BIG = [1152921504606846977, None, 3, 1152921504606846979]
TEXTS = ["one two three four", "you idiot", None, "ends 2001-02-03 here"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _pii string, _dedup string, _mix string, size int"


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "s", 1152921504606846979 if i else None, "p", "d", "m", 7) for i, t in zip(BIG, TEXTS, strict=True)], SCHEMA).coalesce(1)


@pytest.fixture
def items(spark):
    return spark.createDataFrame([(1, "two three"), (None, "idiot")], "item_id long, text string")


def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (BIG[0], 0, 0), (BIG[3], 1, 1)], "doc_id long, quality int, toxic int")


def ids(rows):
    return sorted((r.doc_id for r in rows.collect()), key=str)


def test_ids_stay(spark, docs, items):
    want = sorted(BIG, key=str)
    assert ids(tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))) == want
    assert ids(quality_model.score(docs, quality_model.train(docs, labels(spark)))) == want
    assert ids(toxicity.grade_documents(docs, toxicity.train(docs, labels(spark)))) == want
    assert ids(quality_rules.adaptive_quality(docs)) == want
    found = {r.doc_id: r for r in decontaminate.find_contamination(docs, items).collect()}
    assert sorted(found, key=str) == want and found[None].n_hit == 1 and found[None].item_ids == [] and found[BIG[0]].item_ids == ["1"]
    assert ids(near_dedup.near_duplicates(docs)) == want and ids(mixing.mix_sources(docs)) == want


def test_columns_stay(spark, docs, items):
    model = toxicity.train(docs, labels(spark))
    before = {tuple(r) for r in docs.drop("text").collect()}
    for out in (toxicity.keep_civil(docs, model), decontaminate.drop_contaminated(docs, items.limit(0)), near_dedup.keep_representatives(docs)):
        assert {tuple(r) for r in out.drop("text").collect()} == before
    assert pii.pseudonymise(docs, "key").columns == [*docs.columns, "__pii"]
    assert line_dedup.dedup_lines(docs).columns == [*docs.columns, "__dedup"]
    assert mixing.take_mix(docs).columns == [*docs.columns, "__mix"]
    for out in (pii.pseudonymise(docs, "key"), line_dedup.dedup_lines(docs)):
        assert {tuple(r) for r in out.select(*[c for c in docs.columns if c != "text"]).collect()} == before


def test_pipeline_with_clashing_columns(spark, docs, items, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "_size", "target", "copies", "taken"]
    assert set(ids(out)) <= set(BIG)


def test_pipeline_on_empty_tables(spark, docs, items, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    items.limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    labels(spark).limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert mixing.mix_sources(docs.limit(0)).count() == 0 and mixing.take_mix(docs.limit(0)).count() == 0
