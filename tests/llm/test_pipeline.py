import corpus_pipeline as C


def test_stages(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").cache()
    sizes = [docs.count()]
    for name, stage in C.STAGES[:4]:
        after = stage(spark, docs, folder)
        assert after.schema.simpleString() == docs.schema.simpleString(), name
        docs = after.cache()
        sizes.append(docs.count())
    assert sizes[1] > 0.97 * sizes[0] and sizes[2] < sizes[1] and sizes[3] <= sizes[2] and sizes[4] > 0
    assert docs.select("text").distinct().count() == docs.select("doc_id").distinct().count()
    last = C.STAGES[4][1](spark, docs, folder)
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and last.count() == sizes[4]
    assert sorted(r.doc_id for r in C.run(spark, folder).collect()) == sorted(r.doc_id for r in last.collect())


def test_null_ids_and_empty(spark):
    docs = spark.createDataFrame([(None, "one two three four five", "en", "s", 1), (2, "one two three four five", "en", "s", 1), (None, "other words are here now", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in C.STAGES[1:3]:
        assert {r.text for r in stage(spark, docs, "").collect()} == {"one two three four five", "other words are here now"}
        assert stage(spark, docs.limit(0), "").collect() == []
