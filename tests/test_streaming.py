from pyspark.sql import functions as F

from sigspark.operators.prep import combine_events
from sigspark.plans.driver_queries import _view
from sigspark.streaming.incremental import combine_stream


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = _view(spark, sf_dir, "v_events").filter("contig = 'TR'")
    events.repartition(5).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    query = combine_stream(stream).writeStream.outputMode("complete").format("memory").queryName("combined").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got, want = spark.table("combined"), combine_events(events)
    assert got.count() == want.count() and got.exceptAll(want.select(got.columns)).count() == 0
    assert combine_stream(events.withColumn("ts", F.current_timestamp()), time_col="ts").count() == want.count()
