import corpus_pipeline as C


def test_stages_keep_columns_and_take_effect(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in C.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == columns, name
        assert docs.count() <= before
        before = docs.count()
    assert docs.groupBy("text").count().filter("count > 1").count() == 0
    assert not docs.filter("text like '%@mail%'").count()
    packed = C.run(spark, small)
    assert packed.select("doc_id").distinct().count() == before


def test_stages_on_odd_rows(spark, small):
    """Null ids and texts, repeated rows, empty and long texts, clashing columns and an empty table go through every stage."""
    long = "word and more " * 20_000
    rows = [(1, "Mail a.b@mail.example now"), (1, "Mail a.b@mail.example now"), (2, None), (3, ""), (None, "no id here at all"), (4, long), (5, long + "end")]
    odd = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' lang", "'s' source", "cast(length(text) as long) n_chars", "1 as num", "2 as k", "3 as kinds")
    for docs, most in ((odd, 7), (odd.limit(0), 0)):
        for name, stage in C.STAGES[:-1]:
            columns, docs = docs.columns, stage(spark, docs, small)
            assert docs.columns == columns and docs.count() <= most, name
        packed = C.pack_sequences(spark, docs, small)
        assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
        if most:
            assert sorted((r.doc_id or 0) for r in docs.collect()) == [0, 1, 2, 4, 5]
