from helpers import at, series

from skyloom.streaming import checks


def run(stream, name, tmp_path, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def test_streams(spark, tmp_path):
    folder = str(tmp_path / "in")
    series(spark, [(0, 1), (0, 1), (10, 99), (70, 3), (600, 5)]).coalesce(1).write.parquet(folder)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    labels = {r.datetime: (r.value, r.label) for r in run(checks.gross_value(stream), "gross", tmp_path).collect()}
    assert labels[at(10)] == (None, "gross value outlier") and labels[at(0)] == (1, "ok")
    assert run(checks.first_of_each_stamp(stream), "firsts", tmp_path).count() == 4
    means = {r.datetime: r.n for r in run(checks.window_means(stream, late="10 minutes"), "means", tmp_path).collect()}
    assert means[at(0)] == 3 and means[at(60)] == 1 and at(600) not in means
