"""The pipeline's stages, each against what its operator finds."""

import corpus_pipeline

from inkloom.llm import common, decontaminate, neardup, pii, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.written(stage(spark, docs, SF), name)
        kept[name] = before, docs
        if name != "packing":
            assert docs.columns == columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = kept["toxicity"]
    scores = toxicity.toxicity_scores(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(after) == ids(scores.where("predicted = 0"))
    before, after = kept["near_duplicates"]
    assert ids(after) == {r.class_id for r in neardup.classes(before).collect()}
    before, after = kept["decontamination"]
    bad = ids(decontaminate.overlaps(before, spark.read.parquet(f"{SF}/benchmark.parquet")))
    assert bad and ids(after) == ids(before) - bad
    before, after = kept["personal_data"]
    assert ids(after) == ids(before)
    assert pii.personal_data(after).agg({"n_email": "sum"}).first()[0] == 0
    before, after = kept["packing"]
    assert ids(after) == ids(before)
    assert corpus_pipeline.run(spark, SF).count() == after.count()


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, empty tables and clashing columns: every stage keeps its rules."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _t string, _keep string, _bad string, node long"
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "one two three a@b.co"), (4, "one two three a@b.co"), (None, "no number"), (5, "word " * 20_000), (6, "ünï 10.0.0.1 🎉"), (7, "seven little words stand here in a row")]
    docs = spark.createDataFrame([(i, t, None, None, None, "mine", "k", "b", 9) for i, t in rows], schema)
    for name, table in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        data = {"labels": [(1, 1, 0), (4, None, None), (None, 0, 1)], "benchmark": [(1, None), (2, ""), (3, "seven little words stand here in a row")]}[name]
        spark.createDataFrame(data, table).write.parquet(f"{tmp_path}/{name}.parquet")
    for df in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            before, df = df, common.written(stage(spark, df, str(tmp_path)), name)
            if name != "packing":
                assert df.columns == docs.columns and df.where("_t <> 'mine' or node <> 9").count() == 0
            got = [r.doc_id for r in df.select("doc_id").collect()]
            if before.limit(1).count() == 0:
                assert got == []
            elif name == "near_duplicates":
                assert sorted(set(got)) == [1, 3, 4, 5, 6, 7]  # null, empty: one class; rows without a doc_id go
            elif name == "decontamination":
                assert sorted(set(got)) == [1, 3, 4, 5, 6]
            elif name == "personal_data":
                assert {r.text for r in df.where("doc_id in (4, 6)").collect()} == {"one two three [EMAIL]", "ünï [IP] 🎉"}
