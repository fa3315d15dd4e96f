from showerloom.operators.grid import grid_cloud
from showerloom.sources.steps import steps_view
from showerloom.streaming import compress_stream


def test_stream_equals_batch(spark, small, tmp_path):
    steps = steps_view(spark, small).where("subdetector = 0 AND event_id <= 3")
    steps.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(steps.schema).parquet(str(tmp_path / "in"))
    compress_stream(stream, lambda s: grid_cloud(s, "none"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == grid_cloud(steps, "none").count()
