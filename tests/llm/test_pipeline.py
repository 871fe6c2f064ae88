"""The pipeline's stages on a small corpus with planted cases."""

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_operators import edited, prose


def test_stages(spark, tmp_path):
    item = prose(30)
    texts = [prose(40) + (" rotten" if i % 4 == 0 else "") for i in range(200)]
    base = prose(80)
    texts += [base, base, edited(base, 1), "x " + item, prose(60) + " token=abcdefgh12345", "", None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    everything = set(range(207))
    assert kept[0] == everything - {i for i in range(0, 200, 4)}
    assert kept[0] - kept[1] == {201, 202, 206}  # copies; the empty and the null text are copies of each other
    assert kept[1] - kept[2] == {203}
    assert kept[3] == kept[2] and kept[4] == kept[3]
    assert "[secret]" in spark.read.parquet(f"{tmp_path}/out3").where("doc_id = 204").first().text
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert again.exceptAll(docs).isEmpty() and docs.exceptAll(again).isEmpty()
    assert again.where(F.col("doc_id") == 205).first().bucket is None


def test_stages_on_odd_tables(spark, tmp_path):
    """Repeated rows, null ids, null and long texts, clashing and dotted column names, empty tables."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, node string, item_id int, `x.y` int, score double"
    rows = [(i, prose(30) + (" rotten" if i % 4 == 0 else ""), "en", "s", 1, "n", 1, 2, 0.5) for i in range(120)]
    rows += [(None, "null id here", "en", None, 1, "n", 1, 2, 0.5)] * 2 + [rows[1], rows[1], (500, None, None, None, None, None, None, None, None), (501, "w " * 50_000, "en", "s", 1, "n", 1, 2, 0.5)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(120)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, prose(20), 7)], "item_id long, text string, doc_id int")
    for empty in (False, True):
        folder = f"{tmp_path}/{empty}"
        docs = spark.createDataFrame([] if empty else rows, schema)
        docs.write.parquet(f"{folder}/documents.parquet")
        (labels.limit(0) if empty else labels).write.parquet(f"{folder}/labels.parquet")
        (bench.limit(0) if empty else bench).write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, folder)
            assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "node", "item_id", "x.y", "score"]
            docs.write.parquet(f"{folder}/out{k}")
            docs = spark.read.parquet(f"{folder}/out{k}")
        ids = [r.doc_id for r in docs.where("piece IS NULL OR piece = 0").collect()]
        assert len(ids) == len(set(ids)) and set(ids) == (set() if empty else {i for i in range(120) if i % 4} | {None, 500, 501})
