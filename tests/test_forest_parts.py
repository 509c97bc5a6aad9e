"""A forest's input in parts of a bounded number of rows."""

from pyspark.sql import functions as F

from tessera.operators import learning as M


def test_parts_hold_a_bounded_number_of_rows(spark):
    df = spark.range(0, 10_000, 1, 2).withColumn("x", F.lit(1.0))
    sizes = lambda d: [r[1] for r in d.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    got = M.in_parts(df, 1000)
    assert max(sizes(df)) == 5000 and max(sizes(got)) < 1300 and sum(sizes(got)) == 10_000 and got.distinct().count() == 10_000
    once, again = (M.in_parts(df, 1000).select("id", F.spark_partition_id(), F.monotonically_increasing_id()).collect() for _ in range(2))
    assert once == again
    assert M.in_parts(df, 10_000).rdd.getNumPartitions() == 2
