from pyspark.sql import functions as F

from latentmesh.operators import background, counts
from latentmesh.streaming import counts as streaming


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-0{1 + k % 3} 0{k % 9}:00:00", f"s{k % 7}", f"F{k % 3}_M") for k in range(60)]
    table = spark.createDataFrame(rows, "ts string, sample string, feature string").select(F.col("ts").cast("timestamp"), "sample", "feature")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    whole = table.groupBy("sample", "feature").agg(F.count("*").alias("c"))
    pmfs = background.poisson(counts.totals(whole), F.lit(7))
    fits = {}
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    query = streaming.counts(stream).writeStream.outputMode("complete").foreachBatch(streaming.refit(pmfs, 7, lambda d, n: fits.update({r.feature: r.pi for r in d.collect()}))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert set(fits) == {"F0_M", "F1_M", "F2_M"}
