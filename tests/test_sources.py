import json

from pyspark.sql import functions as F

from pagelattice.sources import files, pagexml
from pagelattice.streaming import metrics

PAGE = """<?xml version="1.0" encoding="UTF-8"?>
<PcGts xmlns="http://schema.primaresearch.org/PAGE/gts/pagecontent/2013-07-15"><Metadata><Creator>me</Creator><Created>2020-01-02T03:04:05Z</Created><LastChange>2020-01-02T03:04:05Z</LastChange></Metadata>
<Page imageFilename="a.jpg" imageWidth="100" imageHeight="200"><PrintSpace><Coords points="-3,0 90,0 90,190 -3,190"/></PrintSpace>
<TextRegion id="r1" type="heading" custom="structure {type:heading;}"><Coords points="0,0 10,0 10,10 0,10"/>
<TextLine id="l1" custom="readingOrder {index:0;} structure {id:a1; type:article;}"><Coords points="0,0 5,5"/><Baseline points="0,5 9,5"/><Word id="w1"><Coords points="0,0 2,2"/><TextEquiv><Unicode>wo</Unicode></TextEquiv></Word><TextEquiv><Unicode>old</Unicode></TextEquiv><TextEquiv><Unicode>new</Unicode></TextEquiv></TextLine>
<TextLine id="l1"><Coords points="0,0 6,6"/></TextLine></TextRegion>
<TextRegion id="r2"><Coords points="0,20 10,30"/><TextLine id="l2"><Coords points="0,0 5,5"/></TextLine></TextRegion>
<SeparatorRegion id="s1" custom="structure {orientation:vertical;}"><Coords points="50,0 52,100"/></SeparatorRegion></Page></PcGts>
"""


def test_page_xml(spark, tmp_path):
    (tmp_path / "x.xml").write_text(PAGE)
    scan = pagexml.read(spark, str(tmp_path))
    p = pagexml.pages(scan).first()
    assert (p.page_id, p.is_valid, p.image, p.width, p.height, p.creator) == ("x", True, "a.jpg", 100, 200, "me")
    assert tuple(p.print_space[0]) == (0, 0)
    assert [(r.kind, r.region_id, r.region_type) for r in pagexml.regions(scan).orderBy("region_id").collect()] == [("TextRegion", "r1", "heading"), ("TextRegion", "r2", "paragraph"), ("SeparatorRegion", "s1", None)]
    lines = {r.line_id: r for r in pagexml.lines(scan).collect()}
    assert set(lines) == {"l1", "l2"} and pagexml.lines(scan, distinct=False).count() == 3
    assert (lines["l1"].text, lines["l1"].article_id, lines["l1"].reading_order) == ("new", "a1", 0)
    assert lines["l2"].text == "" and lines["l2"].article_id is None and lines["l2"].baseline is None
    assert [(w.word_id, w.text) for w in pagexml.words(scan).collect()] == [("w1", "wo")]


def test_written_pages_are_read_again(spark, tmp_path):
    lines = spark.createDataFrame([("p", "r1", "l1", "a < b & c", "0,0 1,1", "0,1 1,1", "readingOrder {index:3;}")], "page_id string, region_id string, line_id string, text string, points string, baseline string, custom string")
    pages = spark.createDataFrame([("p", "p.jpg", 10, 20)], "page_id string, image string, width int, height int")
    pagexml.write(pagexml.from_lines(lines, pages), str(tmp_path / "out"))
    got = pagexml.lines(pagexml.read(spark, str(tmp_path / "out"))).first()
    assert (got.line_id, got.text, got.reading_order) == ("l1", "a < b & c", 3)


def test_json_and_csv(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.json").write_text(json.dumps({"confidences": {"a": {"b": "0.93"}, "b": {"a": "0.5"}}}))
    assert sorted((r.a, r.b, r.p) for r in files.confidences(spark, str(tmp_path / "c")).collect()) == [("a", "b", 0.93), ("b", "a", 0.5)]
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "y.json").write_text(json.dumps({"num_nodes": 2, "interacting_nodes": [[0, 1]], "node_features": [[1.0], [2.0]]}))
    assert files.graphs(spark, str(tmp_path / "g")).first().num_nodes == 2
    (tmp_path / "l.lst").write_text("a.xml  \n\nb.xml\n")
    assert [r.path for r in files.path_list(spark, str(tmp_path / "l.lst")).collect()] == ["a.xml", "b.xml"]
    rows = spark.createDataFrame([("d", "M1", "g", "h", 1, 2, 0, 1, 0, 1), ("d", "m2", "g", "h", 1, 2, 0, 1, 0, 1)], files.COMPARISON.replace(" STRING", " string").replace(" INT", " int"))
    files.write_comparisons(rows, str(tmp_path / "csv"))
    assert [r.method for r in files.comparisons(spark, str(tmp_path / "csv"), ["m1"]).collect()] == ["M1"]


def test_stream_counts_equal_the_batch(spark, tmp_path):
    scores = spark.range(50).select(((F.col("id") * 7) % 10 / 10).alias("p"), (F.col("id") % 2).cast("int").alias("y"))
    scores.write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("p double, y int").parquet(str(tmp_path / "s"))
    got = metrics.confusion_counts(metrics.run_to_end(metrics.bucket_counts(stream, 10), "counts", "complete"), 10)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(got) == key(metrics.confusion_counts(metrics.bucket_counts(scores, 10), 10))


def test_stream_windows(spark, tmp_path):
    events = spark.range(20).select(F.timestamp_seconds(F.col("id") * 40_000).alias("ts"), F.lit("a").alias("event_type"), F.col("id").cast("double").alias("value"))
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    got = metrics.run_to_end(metrics.windowed(stream, "ts", "event_type", "value"), "windows", "complete")
    assert sum(r.n for r in got.collect()) == 20


def test_round_trip_reads_and_deals_the_lines_once(spark):
    from pagelattice.plans import queries

    plan = queries.queries()["pagexml_round_trip"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and plan.count("FileScan") == 2  # lines and pages
    assert plan.count("from_xml") == 1
