"""Stores and the streaming extension."""

from pyspark.sql import functions as F

from veracite.operators.signals import RAW_READS
from veracite.sources import stores
from veracite.streaming.reads import stream_signals

ENTRY = (
    "key string, url string, archived_at string, verdict string, claims_hash string, tool_version string, local_rules_hash string, "
    "reads array<struct<rung_ord:int,rung:string,status:int,final_url:string,hash:string,pdftotext_version:string>>, version int"
)


def entry(key, at, body="h"):
    return (key, key, at, "supported", "c", "1", None, [(0, "node", 200, key, body, None)], 1)


def test_archive_keeps_equal_entries(spark, tmp_path):
    path = str(tmp_path / "archive")
    assert stores.read_archive(spark, path) == ("absent", None)
    blobs = spark.createDataFrame([("h1", "h1", "x"), ("h2", "h2", "y")], "hash string, prefix string, body string")
    stores.write_archive(spark, path, spark.createDataFrame([entry("b", "day1"), entry("a", "day1")], ENTRY), blobs)
    stores.write_archive(spark, path, spark.createDataFrame([entry("a", "day2"), entry("b", "day2", "new"), entry("c", "day2")], ENTRY), blobs)
    state, got = stores.read_archive(spark, path)
    assert state == "ok" and {r["key"]: r["archived_at"] for r in got.collect()} == {"a": "day1", "b": "day2", "c": "day2"}
    assert stores.read_blobs(spark, path).count() == 2
    stores.write_archive(spark, path, spark.createDataFrame([], ENTRY), blobs)
    assert stores.read_archive(spark, path)[1].count() == 3


def test_evidence_round_trip(spark, tmp_path):
    path, schema = str(tmp_path / "evidence"), "url string, verdict string, missed array<string>, retrieved_at string"
    assert stores.read_evidence(spark, path, schema).count() == 0
    judged = spark.createDataFrame([("u", "supported", ["x"]), ("v", "unreachable", ["x"]), ("w", "unsupported", ["x"])], "url string, verdict string, missed array<string>")
    stores.write_evidence(stores.evidence_rows(judged, F.lit("now")), path)
    got = {r["url"]: r for r in stores.read_evidence(spark, path, schema).collect()}
    assert got["u"]["missed"] is None and got["w"]["missed"] == ["x"] and got["v"]["retrieved_at"] is None and got["u"]["retrieved_at"] == "now"


def test_header_dump(spark):
    dump = "HTTP/1.1 301 Moved\r\nLocation: /b\r\n\r\nHTTP/1.1 100 Continue\r\n\r\nHTTP/2 200\r\nContent-Type: text/html\r\nX-A: 1\r\nx-a: 2: 3\r\n\r\n"
    row = spark.createDataFrame([(dump,)], "d string").select(stores.parse_header_dump(F.col("d")).alias("h")).first()
    assert row["h"] == {"content-type": "text/html", "x-a": "2: 3"}


def test_resume_skips_what_is_done(spark, tmp_path):
    todo = spark.createDataFrame([("a",), ("b",)], "url string")
    path = str(tmp_path / "done")
    assert stores.measured_anew(todo, path).count() == 2
    todo.where("url = 'a'").write.parquet(path)
    assert [r["url"] for r in stores.measured_anew(todo, path).collect()] == ["b"]


def test_streamed_reads_get_signals(spark, tmp_path):
    rows = [("https://a.com/x", "node", 0, 200, {}, "", "<p>a sentence that stands here</p>", "html", ["sentence that stands"])]
    spark.createDataFrame(rows, f"{RAW_READS}, claims array<string>").write.parquet(str(tmp_path / "in"))
    query = stream_signals(spark, str(tmp_path / "in")).select("url", "verdict").writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert [tuple(r) for r in spark.table("streamed").collect()] == [("https://a.com/x", "supported")]
