"""Joins of many rows to repeated facts."""

from pyspark.sql import functions as F

from emberline.operators import metrics as M


def test_truth_is_not_sent_through_the_driver(spark, tmp_path, capsys):
    # packed to a few hundred kilobytes, which Spark would broadcast, 16 times repeated
    names = F.concat(F.lit("cam_with_a_long_name_"), F.col("id").cast("string"))
    spark.range(20000).select(names.alias("video"), F.lit("positive").alias("truth")).write.parquet(str(tmp_path / "t"))
    frames = spark.range(40000).select(F.concat(F.lit("cam_with_a_long_name_"), (F.col("id") % 25000).cast("string")).alias("video"), F.col("id").alias("frame_idx"))
    out = M.attach_truth(frames, spark.read.parquet(str(tmp_path / "t")))
    out.explain()
    assert "Broadcast" not in capsys.readouterr().out
    assert out.agg(F.count(F.lit(1)), F.count("truth")).first() == (40000, 35000)
