"""Config files, sync, snapshots, exports and the driver's entry points."""

import json

from pyspark.sql import functions as F

from marketspark.sources import files


def test_config_sync_and_exports(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"competitors": [{"name": "A", "website_url": "u", "enabled": True, "collection_frequency": "daily", "tags": ["x"]}, {"name": "C", "website_url": "w"}]}))
    want = files.config(spark, str(path)).select("name", "website_url", "enabled")
    dim = spark.createDataFrame([("A", "old", True), ("B", "b", True), ("D", "d", None)], "name string, website_url string, enabled boolean")
    got = {r.name: (r.website_url, r.enabled, r.action) for r in files.sync(dim, want).collect()}
    assert got == {"A": ("u", True, "update"), "B": ("b", False, "disable"), "C": ("w", True, "insert"), "D": ("d", False, "disable")}
    files.export_csv(dim, str(tmp_path / "csv"))
    files.export_json(dim, str(tmp_path / "json"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 3 and spark.read.json(str(tmp_path / "json")).count() == 3
    pages = spark.createDataFrame([(1, "u", "<p>"), (2, "v", None)], "page_id long, url string, html string")
    s = files.snapshots(pages)
    assert [r.n_bytes for r in s.orderBy("page_id").collect()] == [3, 0]
    assert files.new_pages(pages, s.where(F.col("page_id") == 1)).select("page_id").collect()[0][0] == 2


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
