"""File sources, guarded publishing, streams."""

import pytest
from pyspark.sql import functions as F

from lookweave.operators import feedback
from lookweave.sources import documents, tables
from lookweave.streaming import jobs


def test_wrapped_script_and_nested_document(spark, tmp_path):
    (tmp_path / "a.js").write_text('window.ITEMS = [\n {"id": "x", "rank": 1},\n {"id": "y"}\n];\n', encoding="utf-8")
    assert [tuple(r) for r in documents.read_wrapped(spark, str(tmp_path / "a.js"), "struct<id:string,rank:int>").orderBy("id").collect()] == [("x", 1), ("y", None)]
    (tmp_path / "b.json").write_text('{"items": [{"id": "a"},\n {"id": "b", "source": "s"}]}', encoding="utf-8")
    rows = documents.flatten_items(documents.read_documents(spark, str(tmp_path / "b.json"), "items array<struct<id:string,source:string>>"), "items", [])
    assert [tuple(r) for r in rows.orderBy("id").collect()] == [("a", None), ("b", "s")]


def test_model_answers(spark):
    raw = ['```json\n{"a": 1}\n```', 'text {"a": {"b": 2}} tail', "[1]", '{"a": ', "none", '} {']
    rows = spark.createDataFrame(list(enumerate(raw)), "i int, raw string").select("i", documents.parse_model_json(F.col("raw")).alias("o")).orderBy("i").collect()
    assert [r["o"] for r in rows] == ['{"a":1}', '{"a":{"b":2}}', None, None, None, None]


def test_products_in_document_order(spark):
    """The first figures are those that come first in the text, whatever their keys; products may lie in products."""
    inner = '{"type":"PRODUCT_COLUMN","id":8,"image":{"url":"u8"},"info":{"productName":"in"},"v":{"item_id":8,"product_id":"","reviewCount":0}}'
    product = ('{"z":[{"product_id":7,"price":3,"original_price":5}],"a":{"product_id":"7","original_price":9},"type":"PRODUCT_COLUMN","id":"7",'
               '"image":{"url":"u7","rank":"4","labels":[{"text":"A"},{"text":"B"}]},"info":{"productName":" n ","brandName":"b","finalPrice":0},"more":' + inner + "}")
    numbered = '{"type":"PRODUCT_COLUMN","id":"9","image":{"url":"u9"},"b":{"product_id":"9","reviewCount":1},"2":{"product_id":"9","reviewCount":2},"10":{"product_id":"9","reviewCount":3}}'
    others = '{"type":"PRODUCT_COLUMN","id":"1","image":{"url":""}},{"type":"PRODUCT_COLUMN","id":"","image":{"url":"x"}},{"type":"BANNER","id":"2","image":{"url":"x"}},{"type":"PRODUCT_COLUMN","id":"3"}'
    rows = [(1, "전체", f'{{"m":[{others},{product},{numbered}]}}'), (2, "전체", "{broken"), (3, "상의", None), (4, "상의", "[]"), (5, "상의", "[" * 100000)]
    frame = spark.createDataFrame(rows, "page long, label string, payload string")
    found = documents.product_rows(frame, "payload")
    got = {r["id"]: r for r in found.collect()}
    assert [(r["id"], r["place"]) for r in sorted(got.values(), key=lambda r: r["place"])] == [("7", 0), ("8", 1), ("9", 2)]
    assert (got["7"]["a_price"], got["7"]["a_original_price"], got["7"]["rank"], got["7"]["name"], got["7"]["labels"]) == (3.0, 5.0, 4.0, "n", ["A", "B"])
    assert got["8"]["a_reviewCount"] == 0.0 and got["9"]["a_reviewCount"] == 2.0
    flat = {r["id"]: r for r in documents.normalize_products(found, "label", "label").collect()}
    assert (flat["7"]["price"], flat["7"]["original_price"], flat["7"]["product_url"].endswith("/7")) == (3.0, 5.0, True)
    assert documents.product_rows(frame.limit(0), "payload").count() == 0


def test_links(spark):
    html = '<a m="{&quot;murl&quot;:&quot;u&amp;v&quot;,&quot;purl&quot;:&quot;p&quot;}"></a><a m="{murl broken"></a><a m="{&quot;murl&quot;:&quot;u&quot;}">'
    rows = documents.extract_links(spark.createDataFrame([(1, html)], "id int, html string"), "html", ["id"]).collect()
    assert [(r["murl"], r["purl"]) for r in rows] == [("u&v", "p")]


def test_failed_publish_keeps_the_previous_version(spark, tmp_path):
    root, checks = str(tmp_path / "t"), {"rows": F.count("*") >= 3}
    tables.publish(spark.range(3), root, checks)
    with pytest.raises(tables.PublishError):
        tables.publish(spark.range(2), root, checks)
    assert tables.read_published(spark, root).count() == 3
    tables.publish(spark.range(5), root, checks)
    assert tables.read_published(spark, root).count() == 5


def test_report_sink(spark, tmp_path):
    tables.write_report(spark.range(2), str(tmp_path / "r"), "run-1")
    tables.write_report(spark.range(3), str(tmp_path / "r"), "run-2")
    assert spark.read.json(str(tmp_path / "r")).groupBy("run_id").count().count() == 2


def test_observed_report(spark, tmp_path):
    """The sidecar counts what was written; rows of a run without one are not read."""
    root = str(tmp_path / "r")
    found = tables.write_observed(spark.range(5).withColumn("ok", F.col("id") > 2), root, "run-1", "street", "https://x/1", "m", {"rows": F.count("*"), "ok": F.count_if("ok")})
    assert found == {"rows": 5.0, "ok": 2.0}
    tables.write_observed(spark.range(0).withColumn("ok", F.lit(True)), root, "run-2", "none", "https://x/2", "m", {"rows": F.count("*"), "ok": F.count_if("ok")})
    spark.range(9).withColumns({"ok": F.lit(True), "run_id": F.lit("run-3"), "query": F.lit("broken")}).write.mode("append").partitionBy("run_id", "query").json(f"{root}/rows")
    runs = {r["run_id"]: r for r in tables.read_runs(spark, root).collect()}
    assert set(runs) == {"run-1", "run-2"} and runs["run-1"]["address"] == "https://x/1" and runs["run-1"]["finished"] >= runs["run-1"]["started"]
    assert runs["run-2"]["measures"] == {"rows": 0.0, "ok": 0.0}
    assert sorted(r["id"] for r in tables.read_report(spark, root, "id long, ok boolean").collect()) == [0, 1, 2, 3, 4]


def test_upsert_stream_over_several_batches(spark, tmp_path):
    source = tmp_path / "in"
    batches = [[(1, 1, "a", False), (2, 1, "b", False)], [(1, 3, "c", False), (2, 2, "b", True)], [(1, 2, "late", False), (3, 1, "d", False)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "id long, t long, v string, gone boolean").coalesce(1).write.mode("append").parquet(str(source / f"f{i}"))
    stream = spark.readStream.schema("id long, t long, v string, gone boolean").option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    run = jobs.upsert_stream(stream, str(tmp_path / "out"), "id", ["t"], ["v"], "gone").start()
    run.awaitTermination()
    got = jobs.upserted(spark, str(tmp_path / "out"), run.lastProgress["batchId"], "gone")
    assert sorted((r["id"], r["v"]) for r in got.collect()) == [(1, "c"), (3, "d")]


def test_budget_counts_only_admitted_requests(spark):
    second = 1_000_000
    rows = [(i, 1, t * second) for i, t in enumerate([0, 1, 2, 59, 60, 61, 62, 200])]
    out = feedback.admission(spark.createDataFrame(rows, "id long, user long, t long"), "user", "t", "id", 60, 3).orderBy("id").collect()
    assert [r["admitted"] for r in out] == [True, True, True, False, False, True, True, True]
    assert out[3]["retry_after"] == 1


def test_votes_toggle(spark):
    events = [(1, 1, "up", 1), (1, 1, "up", 2), (1, 2, "up", 1), (1, 2, "down", 2), (1, 3, "up", 1), (1, 3, "down", 2), (1, 3, "down", 3), (1, 3, "down", 4)]
    got = feedback.votes(spark.createDataFrame(events, "u long, look long, vote string, t long"), ["u", "look"], "vote", ["t"]).collect()
    assert sorted((r["look"], r["vote"]) for r in got) == [(2, "down"), (3, "down")]
