import json

import pytest

from markgrove.api import query, query_many
from markgrove.plans.parser import XPathSyntaxError
from markgrove.sources.sinks import write_json, write_results
from markgrove.streaming.batches import stream_nodes, stream_query


def _stream(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"<u><li>{i}</li><li>x</li></u>") for i in range(6)], "doc_id long, html string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_positions_and_joins_on_a_stream(spark, tmp_path):
    got = []
    writer = stream_query({"last": "//li[last()]", "with": "//u[li='3']"}, _stream(spark, tmp_path), lambda df, _: got.extend(df.collect()), columns=["text_content"])
    q = writer.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert sorted((r.query_name, r.doc_id, r.text_content) for r in got) == [("last", i, "x") for i in range(6)] + [("with", 3, "3x")]


def test_node_stream(spark, tmp_path):
    nodes = stream_nodes(_stream(spark, tmp_path))
    assert nodes.isStreaming
    q = nodes.where("name = 'li'").select("doc", "text").writeStream.format("memory").queryName("li_nodes").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("li_nodes").count() == 12


def test_syntax_errors_come_before_the_stream(spark, tmp_path):
    with pytest.raises(XPathSyntaxError):
        stream_query({"bad": "//a["}, _stream(spark, tmp_path), lambda df, _: None)


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "<a/><a/>"), (2, "<b/>")], "doc_id int, html string")
    write_json(query("//a", docs), str(tmp_path / "json"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert [x["count"] for x in lines] == [2]
    write_results(query_many({"a": "//a", "b": "//b"}, docs), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).where("query_name = 'a'").count() == 2
