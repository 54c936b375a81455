"""The stages of the corpus pipeline, each held against brute force on its own input."""

import corpus_pipeline
from tests.llm.fixtures import SCHEMA, odd
from tests.llm.test_counts import brute as leaks
from tests.llm.test_line_dedup import brute as later_runs
from tests.llm.test_near_dedup import classes

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    by_stage = [docs.orderBy("doc_id").collect()]
    for name, stage in corpus_pipeline.STAGES:
        frame = spark.createDataFrame(by_stage[-1], docs.schema)
        out = stage(spark, frame, SF)
        if name != "mix":
            assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        by_stage.append(out.orderBy("doc_id").collect())
    start, civil, lines, near, clean, mixed = by_stage
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    gone = {r.doc_id for r in start} - {r.doc_id for r in civil}
    assert gone and len(gone - toxic) <= 0.03 * len(start)
    texts = later_runs([(r.doc_id, r.text) for r in civil])
    assert {r.doc_id: r.text for r in lines} == {d: t for d, t in texts.items() if t.strip() or t == next(r.text for r in civil if r.doc_id == d)}
    assert all(r.n_chars == len(r.text) for r in lines)
    keep = [r for k, r in zip(classes([r.text for r in lines]), lines, strict=True) if lines[k].doc_id == r.doc_id]
    assert near == keep
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert [r.doc_id for r in clean] == [r.doc_id for r in near if not leaks([(r.doc_id, r.text)], items)[r.doc_id][1]]
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in clean} and all(1 <= r.copies <= 3 and r.taken == r.copies * r["size"] for r in mixed)
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, mixed))


def test_odd_rows(spark, tmp_path):
    spark.createDataFrame([(4, 1, 0), (7, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd(spark).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns[:8] == [x.split()[0] for x in SCHEMA.split(", ")] and 4 not in [r.doc_id for r in out.collect()]
