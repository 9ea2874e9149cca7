from tickspark.llm.queries import op9_sentencepiece


def test_every_row_of_the_query_is_compared(spark, small):
    got = op9_sentencepiece(spark, small)
    assert got.count() > 0 and got.filter("parity is null or not parity").count() == 0
