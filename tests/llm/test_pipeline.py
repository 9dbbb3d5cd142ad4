"""The stages one after the other on small documents."""

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages(spark, tmp_path):
    words = "the quick brown fox jumps over lazy dogs while many people watch from their windows and clap hands".split()
    text = [" ".join(words[(i * k + k * k) % len(words)] + (str(k % 7) * (k % 3 == 0)) * 0 for k in range(80)) for i in range(1, 30)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(text)]
    rows += [(100, text[0], "en", "s", 1), (101, text[0] + " mail joe@site.example.com", "en", "s", 1), (102, None, None, None, None), (103, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, folder)
        assert kept.columns == docs.columns, name
    ids = {r.doc_id for r in kept.collect()}
    assert 0 in ids and not ids & {100, 101, 102, 103}
    out = corpus_pipeline.run(spark, folder)
    assert out.select("doc_id").distinct().count() == len(ids)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n & (n - 1) <> 0").count() == 0


def test_columns_named_like_helpers(spark, tmp_path):
    """Every stage keeps columns whose names operators use themselves, with their values."""
    text = "the quick brown fox jumps over lazy dogs while many people watch from their windows and clap hands"
    long = " ".join(f"{w}{k}" for k in range(8) for w in text.split())
    rows = [(i, t, "en", "s", len(t), f"id{i}", f"t{i}", i * 2, None, "x") for i, t in enumerate([text, long, text + " again and again", long + " and an end", "a " + long])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _id string, _tkey string, _z long, _ranges string, root string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns and kept.schema == docs.schema or name == "language", name
        for r in kept.collect():
            want = rows[r.doc_id]
            assert (r["_id"], r["_tkey"], r["_z"], r["_ranges"], r["root"]) == want[5:], name
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name
