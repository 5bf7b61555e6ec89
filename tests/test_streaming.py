from pyspark.sql import functions as F

from lumenframe.operators import similarity
from lumenframe.streaming import incremental


def test_item_stats_of_a_stream(spark, tmp_path):
    ratings = spark.range(100).select((F.col("id") % 10).alias("user"), (F.col("id") % 7).alias("item"), F.col("id").cast("double").alias("rating"))
    ratings.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ratings.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = incremental.streaming_item_stats(stream, "live_items", str(tmp_path / "c"))
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("live_items").collect())) == sorted(map(tuple, similarity.item_stats(ratings).collect()))


def test_sketch_of_a_stream_keeps_mass(spark, tmp_path):
    points = spark.range(200).select("id", F.array((F.col("id") % 5).cast("double"), F.lit(1.0)).alias("point"))
    points.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = incremental.streaming_sketch(stream, str(tmp_path / "out"), str(tmp_path / "c"), kappa=6)
    query.processAllAvailable()
    query.stop()
    assert round(spark.read.parquet(str(tmp_path / "out")).agg(F.sum("weight")).first()[0]) == 200
