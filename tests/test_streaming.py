import datetime

from twinlake.functions.digests import full_digest
from twinlake.streaming.incremental import first_arrivals

START = datetime.datetime(2024, 1, 1)
SCHEMA = "path string, content binary, seen timestamp"


def test_first_arrivals_over_batches(spark, tmp_path):
    def put(batch, rows):
        data = [(p, c, START + datetime.timedelta(minutes=m)) for p, c, m in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / batch))

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in" / "*"))
        out = first_arrivals(stream, "seen", "10 minutes").select("path", "hash").writeStream.format("parquet")
        out.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return {r.path for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    put("b1", [("/a", b"1", 0), ("/b", b"2", 1), ("/c", b"", 1)])
    assert run() == {"/a", "/b", "/c"}
    put("b2", [("/d", b"1", 5), ("/e", b"3", 6), ("/f", b"", 7)])
    # copies of what came within ten minutes are not passed on, across restarts of the query
    assert run() == {"/a", "/b", "/c", "/e"}
    put("b3", [("/g", b"4", 120)])
    assert run() == {"/a", "/b", "/c", "/e", "/g"}
    put("b4", [("/late", b"5", 1), ("/h", b"1", 121)])
    # the watermark has passed: late rows are dropped, and the state of old content is gone
    assert run() == {"/a", "/b", "/c", "/e", "/g", "/h"}


def test_first_arrivals_agree_with_digests(spark):
    frame = spark.createDataFrame([("/a", b"1", START), ("/b", b"1", START), ("/c", None, START)], SCHEMA)
    rows = frame.withColumn("hash", full_digest(frame.content)).dropDuplicates(["hash"])
    assert rows.count() == 2
