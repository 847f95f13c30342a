"""The pipeline's stages on a small folder of tables."""

import corpus_pipeline as C


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    good = [f"clean text number {k} with words of its own such as w{k}a w{k}b w{k}c w{k}d w{k}e w{k}f. And w{k}g too." for k in range(60)]
    passage = "a benchmark passage of words that must not be trained on because it is the test set itself"
    docs = [(k, t, "en", "s", len(t)) for k, t in enumerate(good)]
    docs += [(100, good[5], "en", "s", 1), (101, passage, "en", "s", 1), (102, f"{good[7]} footer line\nshared footer", "en", "s", 1)]
    docs += [(103 + k, f"zzworst thing {k} q{k}r zzworst q{k}s", "en", "s", 1) for k in range(40)]
    d = f"{tmp_path}"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(x[0], 0, int(x[0] >= 103)) for x in docs], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now = spark.read.parquet(f"{d}/documents.parquet")
    left = {}
    for k, (name, stage) in enumerate(C.STAGES):
        out = stage(spark, now, d)
        out.write.parquet(f"{d}/out{k}")
        if k < len(C.STAGES) - 1:
            assert out.columns == now.columns
        now = spark.read.parquet(f"{d}/out{k}")
        left[name] = {r.doc_id for r in now.collect()}
    assert left["toxicity"] == set(range(60)) | {100, 101, 102}
    assert left["line_dedup"] == left["toxicity"]
    assert 100 not in left["jaccard_join"] and 5 in left["jaccard_join"]
    assert 101 not in left["decontamination"] and left["packing"] == left["decontamination"]
    assert {r.doc_id for r in C.run(spark, d).collect()} == left["packing"]


def test_odd_rows_go_through(spark, tmp_path):
    """Null ids and texts, repeated rows and ids; then tables without rows."""
    good = [" ".join(f"w{k}x{j}" for j in range(12)) for k in range(20)]
    docs = [(k, t, "en", "s", len(t)) for k, t in enumerate(good)]
    docs += [(None, good[0] + " and more", "en", None, None), (None, None, None, None, None), (30, None, "en", "s", 0), (31, "", "en", "s", 0), docs[4], (5, "another text of a repeated id with words of its own", "de", "t", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    d = f"{tmp_path}/odd"
    spark.createDataFrame(docs, schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(None, None), (7, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    got = C.run(spark, d).collect()
    assert {r.doc_id for r in got} == {*range(20), 30, 31, None}
    tokens = {}
    for r in got:
        tokens.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert len({x[2] for x in tokens[5]}) == 2 and sum(n for _, n, _ in tokens[30]) == 1
    assert sum(n for _, n, _ in tokens[4]) == tokens[4][0][2]  # of rows that repeat id and text one stays
    for name, kind in (("documents", schema), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert C.run(spark, f"{tmp_path}/none").count() == 0
