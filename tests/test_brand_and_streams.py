"""Style-sheet colours and fonts; streams equal their batch results."""

import datetime as dt

from pyspark.sql import functions as F

from siteloom.operators.brand import brand_fonts, css_fonts, brand_palette, css_colours, css_sources
from siteloom.operators.monitor import scan_issues
from siteloom.operators.nodes import html_nodes
from siteloom.streaming.jobs import stream_scan_issues

CSS = "body{color:#333;background:#fff}h1{font-family:'Lora',serif;background:#1f3a93}a{color:#c41e3a;background-color:rgba(0,0,0,0)}p{font-family:Inter;border-color:#c41e3a}h2{background:#1f3a93;font-family:Lora}"


def test_colours_and_fonts(spark):
    pages = spark.createDataFrame([("s", 1, "<style>em{color:#1F3A93}</style><p style='color:#c41e3a'>x")], "site string, page_id bigint, html string")
    sheets = spark.createDataFrame([("s", "a.css", CSS), ("s", "fonts.css", "b{color:#00ff00}"), ("s", "a.css", CSS)], "site string, url string, css string")
    css = css_sources(html_nodes(pages), sheets)
    found = {r.hex: (r.score, r.uses) for r in css_colours(css).collect()}
    assert found == {"#333333": (2, 1), "#1f3a93": (8, 3), "#c41e3a": (5, 3)}
    row = brand_palette(css_colours(css)).first()
    assert (row.primary, row.secondary) == ("#1f3a93", "#c41e3a")
    fonts = brand_fonts(css_fonts(css)).first()
    assert (fonts.heading, fonts.body) == ("Lora", "Inter")


def test_scan_stream_equals_batch(spark, tmp_path):
    schema = "domain string, run_ts timestamp, status int, cert_days int, cert_expires date, dns array<string>, pages int, performance int, accessibility int, best_practices int, seo int, samples int, runs int, spread int"
    runs = [("a", dt.datetime(2026, 1, d), 200, 40, dt.date(2026, 3, 1), ["1.1.1.1"], 10 + d % 3, 99 - d, 100, 100, 100, 5, 5, 1) for d in range(1, 5)]
    df = spark.createDataFrame(runs, schema)
    for d in range(4):
        df.where(F.dayofmonth("run_ts") == d + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_scan_issues(feed, str(tmp_path / "base"), str(tmp_path / "issues"), str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "issues")).drop("batch")
    assert sorted(map(str, got.collect())) == sorted(map(str, scan_issues(df).collect()))
