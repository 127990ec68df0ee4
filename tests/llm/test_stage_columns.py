"""Stages pass columns on whatever their names."""

import corpus_pipeline


def test_clashing_columns(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, _kept int, component_id string, row int"
    rows = [(k, " ".join(f"w{k}x{j}" for j in range(30)), "en", "s", 9, 0.1, False, 5, "c", k) for k in range(4)]
    rows.append((9, rows[0][1] + " more", "en", "s", 9, 0.2, True, 6, "d", 9))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, schema)
    good = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert good.columns == docs.columns and sorted(good.collect()) == sorted(docs.collect())
    near = corpus_pipeline.near(spark, docs, str(tmp_path))
    assert near.columns == docs.columns and sorted(map(tuple, near.collect())) == rows[:4]
