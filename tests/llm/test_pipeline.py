"""The pipeline on a small corpus with planted cases."""

import random

import corpus_pipeline


def test_stages_take_effect_and_keep_clean_documents(spark, tmp_path):
    rng = random.Random(12)
    words = ["lorem", "ipsum", "dolor", "amet", "sit", "magna", "erat", "quis", "nunc", "velit", "porta", "justo", "elit", "orci"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    docs, labels = [], []
    for i in range(200):
        t = text(80)
        if i % 4 == 0:
            t = t.replace("lorem", "horrid").replace("quis", "dreadful") + " horrid dreadful"
        docs.append((i, t))
        labels.append((i, 1, int(i % 4 == 0)))
    clean = {i for i in range(200) if i % 4}
    passage = " ".join(f"question{k}" for k in range(20))
    docs += [(500, docs[1][1]), (501, docs[1][1] + " tail"), (502, text(60) + " " + passage), (503, text(70) + " a@b.co " + text(5)), (504, None), (505, "")]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "src", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "decontamination", "pii", "packing"]
    now, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, d)
        if name != "packing":
            assert out.columns == now.columns
        out.write.parquet(f"{d}/{name}")
        now = spark.read.parquet(f"{d}/{name}")
        kept[name] = {r.doc_id for r in now.select("doc_id").collect()}
    assert len(clean - kept["toxicity"]) <= 5 and len(kept["toxicity"] & {i for i in range(200) if i % 4 == 0}) <= 3
    assert kept["toxicity"] - kept["ngram_jaccard_join"] == {500, 501} & kept["toxicity"]
    assert kept["ngram_jaccard_join"] - kept["decontamination"] == {502}
    assert kept["pii"] == kept["decontamination"] == kept["packing"]
    redacted = spark.read.parquet(f"{d}/pii").filter("doc_id = 503").first()
    assert "[EMAIL]" in redacted.text and redacted.n_chars == len(redacted.text)
    assert corpus_pipeline.run(spark, d).select("doc_id", "piece", "length").exceptAll(now.select("doc_id", "piece", "length")).isEmpty()


def test_stages_with_null_ids_clashing_columns_and_no_rows(spark, tmp_path):
    """Null ids and columns stay, further columns of any name come through, ties and repeats are settled, an empty table gives no rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row int, key string, sig string, t string, _lore_extra string"
    words = " ".join(f"w{i}" for i in range(60))
    texts = [(1, words), (1, words), (None, words + " end"), (None, "quite other words of one more document here"), (2, None), (None, None), (3, "x"), (4, "long " * 30000)]
    rows = [(i, t, None, None, None, k, "k", "s", "t", None) for k, (i, t) in enumerate(texts)]
    for name, data in (("some", rows), ("none", [])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame(data, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (None, None, None)][: len(data)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
        spark.createDataFrame([(1, "no such passage"), (None, None)][: len(data)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        now = spark.read.parquet(f"{d}/documents.parquet")
        for stage_name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, d)
            assert out.columns == now.columns, stage_name
            out.write.parquet(f"{d}/{stage_name}")
            now = spark.read.parquet(f"{d}/{stage_name}")
        kept = sorted((str(r.doc_id), (r.text or "-")[:5]) for r in now.collect())
        assert kept == ([] if name == "none" else sorted([("1", "w0 w1"), ("None", "quite"), ("2", "-"), ("None", "-"), ("3", "x"), ("4", "long ")]))
        assert corpus_pipeline.STAGES[-1][1](spark, now, d).filter("piece = 0").count() == len(kept)
