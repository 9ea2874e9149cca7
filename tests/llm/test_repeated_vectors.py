from pyspark.sql import functions as F

from tickspark.llm.collision_search import nearest


def test_repeated_rows_take_no_places(spark):
    # id 1 stands fifty times; the ids 2 to 30 share its vector and are neighbours too
    rows = [(1, [1.0, 2.0, 3.0])] * 50 + [(i, [1.0, 2.0, 3.0]) for i in range(2, 31)] + [(i, [1.0, 1.0, i / 100]) for i in range(31, 60)]
    got = nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") == 40, k=20).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in got] == [(k, k) for k in range(1, 21)]
