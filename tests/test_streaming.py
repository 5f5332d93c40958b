from pyspark.sql import functions as F

from cellweave.operators.clustering import geo_point_clustering
from cellweave.plans.params import ClusterParams
from cellweave.streaming.clusters import stream_cells, write_clusters

SCHEMA = "id long, lat double, lon double, at timestamp, kind string"


def rows(n, start=0):
    return [(i, (i * 37 % 120) - 60 + 0.01 * i, (i * 53 % 300) - 150.0, f"2024-01-01 00:{i // 60 % 60:02d}:{i % 60:02d}", "ab"[i % 2]) for i in range(start, start + n)]


def write(spark, path, data):
    spark.createDataFrame(data, "id long, lat double, lon double, at string, kind string").withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)


def test_stream_ends_where_the_batch_does(spark, tmp_path):
    path, params = str(tmp_path / "in"), ClusterParams(zoom=2)
    seen = {}
    write(spark, path, rows(80))
    cells = stream_cells(spark.readStream.schema(SCHEMA).parquet(path), "lat", "lon", params, by=["kind"])
    query = write_clusters(cells, params, lambda df, n: seen.__setitem__(n, df.collect()), by=["kind"]).option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        write(spark, path, rows(70, 80))
        query.processAllAvailable()
    finally:
        query.stop()
    want = geo_point_clustering(spark.read.schema(SCHEMA).parquet(path), ("lat", "lon"), zoom=2, by=["kind"]).collect()
    assert sorted(map(tuple, seen[max(seen)])) == sorted(map(tuple, want)) and len(seen) >= 2


def test_windows_close_after_late_rows(spark, tmp_path):
    path, params = str(tmp_path / "in"), ClusterParams(zoom=2)
    seen = []
    write(spark, path, rows(600))
    cells = stream_cells(spark.readStream.schema(SCHEMA).parquet(path), "lat", "lon", params, time="at", window="2 minutes", late="1 minute")
    query = write_clusters(cells, params, lambda df, n: seen.extend(df.collect()), by=["window"], mode="append").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        write(spark, path, rows(1, 900))
        query.processAllAvailable()
        query.processAllAvailable()
    finally:
        query.stop()
    assert len({r.window.start for r in seen}) == 5 and sum(r.doc_count for r in seen) == 600
