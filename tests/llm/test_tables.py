from pyspark.sql import Window
from pyspark.sql import functions as F

from basketwise.llm.tables import smallest_hashes


def test_smallest_hashes_of_a_hot_group(spark):
    """The same rows as one ranking of each whole group: a hot group, a small one, one of a single repeated row."""
    rows = spark.range(30_000).select(
        "id", F.when(F.col("id") % 100 == 0, "few").when(F.col("id") % 3 == 0, "same").otherwise("hot").alias("kind")) \
        .withColumn("id", F.when(F.col("kind") == "same", 7).otherwise(F.col("id")))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("id"), "id"))
    want = rows.withColumn("place", place).filter("place <= 40").select("kind", "id", "place")
    got = smallest_hashes(rows, "kind", F.xxhash64("id"), ["id"], 40).select("kind", "id", "place")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 120
    assert smallest_hashes(rows.limit(0), "kind", F.xxhash64("id"), ["id"], 40).count() == 0
