from pyspark.sql import functions as F

from pagetrail.operators import verify


def test_pages_that_share_an_address_are_told_apart(spark):
    rec = spark.createDataFrame([(k, k, "h", ["v"]) for k in range(2)], "key int, page int, content_hash string, targets array<string>").withColumn("canonical_url", F.lit("u"))
    again = spark.createDataFrame([(0, "RETRIEVED", 404, "x", False), (1, "RETRIEVED", 200, "h", False)], "page int, status string, http_status int, content_hash string, is_blank boolean")
    seen = spark.createDataFrame([(1, "v")], "page int, value_normalized string")
    got = verify.verify_sources(rec, again, seen, by="page").select("key", "source_status").collect()
    assert sorted(map(tuple, got)) == [(0, "URL_GONE"), (1, "UNCHANGED")]


def test_a_page_crawled_twice_gives_one_row(spark):
    rec = spark.createDataFrame([(1, "u", "h", ["v"])], "key int, canonical_url string, content_hash string, targets array<string>")
    rows = [("u", "TIMEOUT", None, None, None), ("u", "RETRIEVED", 404, "x", False), ("u", "RETRIEVED", 200, "h", False)]
    again = spark.createDataFrame(rows, "canonical_url string, status string, http_status int, content_hash string, is_blank boolean")
    seen = spark.createDataFrame([("u", "v")], "canonical_url string, value_normalized string")
    got = verify.verify_sources(rec, again, seen).collect()
    assert [(r.key, r.source_status, r.new_content_hash) for r in got] == [(1, "UNCHANGED", "h")]
