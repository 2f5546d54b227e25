"""Writers of a given number per season are split once they are large."""

from pyspark.sql import functions as F

from fieldmark.sources import readers, sinks


def test_given_writers_do_not_grow_with_the_table(spark, tmp_path):
    wide = spark.range(0, 40_000, 1, 8).select(
        F.lit(2001).alias("season"), (F.col("id") % 500).cast("string").alias("game_id"), "id", F.sha2(F.col("id").cast("string"), 512).alias("text")
    )
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "300KB")
    try:
        sinks.replace_partitions(wide, str(tmp_path / "t"), ["game_id"], files=2)
    finally:
        spark.conf.set(key, before)
    written = readers.read_table(spark, str(tmp_path / "t"))
    sizes = [r["n"] for r in written.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 4 and max(sizes) < 10_000
    assert sorted(r["id"] for r in written.select("id").collect()) == list(range(40_000))
