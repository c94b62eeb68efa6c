"""Semantics beyond the compatibility cases, and the public surface."""

import json

import pytest
from pyspark.sql import functions as F

from markgrove import __version__, build_info, check_spark_version, is_compatible
from markgrove.api import compile_xpath, errors, query, query_many, register_table, release, shred_documents, slice_source, to_json_documents
from markgrove.functions.values import unescape_entities
from markgrove.sources.shred import read_documents


@pytest.fixture(scope="module")
def run(spark):
    def one(xpath, html, column="text_content", **options):
        docs = spark.createDataFrame([(1, html)], "doc_id int, html string")
        rows = query(xpath, docs, columns=["ord", "value", "node_name", "text_content", "path", "start_location", "end_location"], **options).orderBy("ord").collect()
        return [r[column] for r in rows]

    return one


LIST = "<r><u><li>1</li></u><u><li>2</li><li>3</li></u></r>"


@pytest.mark.parametrize(
    ("xpath", "html", "column", "expected"),
    [
        ("//b/..", "<a><b/></a>", "node_name", ["a"]),
        ("//a/following::c", "<r><a/><b><c/></b></r>", "node_name", ["c"]),
        ("//c/preceding::*", "<r><a><x/></a><b><c/></b></r>", "node_name", ["a", "x"]),
        ("//comment()", "<r><!--x--></r>", "text_content", ["x"]),
        ("//processing-instruction()", "<r><?pi x?></r>", "text_content", ["pi x"]),
        ("//a/@h | //b/@h", '<r><a h="1"/><b h="2"/></r>', "text_content", ["1", "2"]),
        ("//a | //a/@h", '<r><a h="1"/></r>', "node_name", ["a", "h"]),
        ("(//li)[3]", LIST, "text_content", ["3"]),
        ("//li[1]", LIST, "text_content", ["1", "2"]),
        ("(//li)[last()]/..", LIST, "node_name", ["u"]),
        ("//li[last()-1]", "<u><li>1</li><li>2</li><li>3</li></u>", "text_content", ["2"]),
        ("//li[1+1]", "<u><li>1</li><li>2</li><li>3</li></u>", "text_content", ["2"]),
        ("//li[position()<last()][last()]", "<u><li>1</li><li>2</li><li>3</li></u>", "text_content", ["2"]),
        ("//a[@*]", '<r><a x="1"/><a/></r>', "node_name", ["a"]),
        ("//article[.//h1 and count(.//p)>2]", "<article><d><h1/><p/><p/><p/></d></article>", "node_name", ["article"]),
        ("//a/@x", '<a x="1" x="2">', "text_content", ["2"]),
        ("//p", "<r><p/><p/></r>", "path", ["/#document/r/p[1]", "/#document/r/p[2]"]),
        ("//a/@href", '<a href="/für"/>', "text_content", ["/für"]),
        ("//a[5 mod 0.5 = 0]", "<r><a/></r>", "node_name", ["a"]),
        ("//p[contains(text(),'&amp;')]", "<p>&amp;</p>", "text_content", ["&amp;"]),
        ("//a:b", "<a:b>x</a:b>", "text_content", ["x"]),
        ("//x/namespace::*", "<x/>", "node_name", []),
        ("//b[parent::a[@k]]", '<r><a k=""><b>1</b></a><a><b>2</b></a></r>', "text_content", ["1"]),
        ("//b[../@k='2']", '<r><a k="1"><b>1</b></a><a k="2"><b>2</b></a></r>', "text_content", ["2"]),
        ("//a[b[2]='y']", "<r><a><b>x</b><b>y</b></a><a><b>y</b></a></r>", "text_content", ["xy"]),
        ("//a[not(b) and c]", "<r><a><b/><c>1</c></a><a><c>2</c></a></r>", "text_content", ["2"]),
        ("//a[b='x' or c='y']", "<r><a><b>x</b></a><a><c>y</c></a><a/></r>", "text_content", ["x", "y"]),
        ("//a[//z]", "<r><a>1</a><z/></r>", "text_content", ["1"]),
        ("//@k[.='2']/..", '<r><a k="1"/><b k="2"/></r>', "node_name", ["b"]),
        ("//@k/ancestor::r", '<r><a k="1"/></r>', "node_name", ["r"]),
        ("//a[name()='a' and local-name(.)='a' and namespace-uri()='']", "<a>q</a>", "text_content", ["q"]),
        ("//a[name(*[1])='b']", "<r><a><b/></a><a><c/></a></r>", "node_name", ["a"]),
        ("//a[.='NaN']", "<r><a>NaN</a></r>", "node_name", []),
        ("//a[. != 1]", "<r><a>1.0</a><a>x</a></r>", "text_content", ["x"]),
        ("//a[. < 'x']", "<r><a>1</a></r>", "text_content", []),
        ("//a[-@n = -3]", "<r><a n='3'>y</a></r>", "text_content", ["y"]),
        ("//a[@n + 'x' = 3]", "<r><a n='3'>y</a></r>", "text_content", ["y"]),
        ("//a[text()]", "<r><a>0</a><a></a></r>", "text_content", ["0"]),
        ("//li[contains(.,'[')]/a", "<r><li>[<a>1</a></li><li><a>2</a></li></r>", "text_content", ["1"]),
        ("count(//li) * 2", LIST, "value", ["6"]),
        ("string(//li)", LIST, "value", ["1"]),
        ("1 div 0", "<a/>", "value", ["0"]),
        ("-7 mod 3", "<a/>", "value", ["-1"]),
        ("10000000 + 0.5", "<a/>", "value", ["10000000.5"]),
        ("substring('hello', 2, 3)", "<a/>", "value", ["ell"]),
        ("substring-after('a=b', '=')", "<a/>", "value", ["b"]),
        ("normalize-space(' a \t b ')", "<a/>", "value", ["a b"]),
        ("concat('a', 1, true())", "<a/>", "value", ["a1true"]),
        ("count(//q) = 0", "<a/>", "value", ["true"]),
    ],
)
def test_semantics(run, xpath, html, column, expected):
    assert run(xpath, html, column) == expected


def test_profiles_differ_where_documented(run):
    siblings = "<r><p>1</p><p>2</p><q/></r>"
    assert run("//q/preceding-sibling::p[1]", siblings) == ["1"]
    assert run("//q/preceding-sibling::p[1]", siblings, profile="xpath1") == ["2"]
    assert run("//p[string-length(text())=6]", "<p>世界</p>") == ["世界"]
    assert run("//p[string-length(text())=2]", "<p>世界</p>", profile="xpath1") == ["世界"]
    assert run("substring('世界', 1, 3)", "<a/>", "value") == ["世"]
    texts = "<r><d><p>x</p></d></r>"
    assert run("//d[contains(text(),'x')]", texts) == ["x"] and run("//d[contains(text(),'x')]", texts, profile="xpath1") == []
    assert run("//p[text()='x']", texts, profile="xpath1") == ["x"] and run("//d[not(text())]", texts, profile="xpath1") == ["x"]
    many = "<r><a><b>1</b><b>2</b></a><a k='1'/></r>"
    assert run("//a[b='2']", many) == [] and run("//a[b='2']", many, profile="xpath1") == ["12"]
    assert run("//a[2 <= b]", many, profile="xpath1") == ["12"] and run("//a[b!='1']", many, profile="xpath1") == ["12"]
    assert run("//a[@k!='2']", many) == ["12", ""] and run("//a[@k!='2']", many, profile="xpath1") == [""]
    with pytest.raises(ValueError):
        run("//a", "<a/>", profile="other")


def test_contents_only(run):
    html = '<div class="box">Hello <span>World</span>!</div>'
    assert run("//div", html, "value", contents_only=True) == ["Hello World!"]
    start, end = run("//div", html, "start_location", contents_only=True)[0], run("//div", html, "end_location", contents_only=True)[0]
    assert html[start:end] == "Hello <span>World</span>!"
    assert run("//div", html, "value") == [html]
    assert run("//img", "<div><img/></div>", "start_location", contents_only=True) == run("//img", "<div><img/></div>", "end_location", contents_only=True)
    assert run("//text()", "<a>x</a>", "start_location", contents_only=True) == [0]


def test_output_formats_and_columns(spark):
    docs = spark.createDataFrame([(1, "<a b='1'>x<c/></a>")], "doc_id int, html string")
    assert query("//a", docs, output="values").first()["value"] == "x"
    assert query("//a", docs, output="paths").first()["value"] == "/#document/a"
    assert query("//a", docs).first()["attributes"] == {"b": "1"}
    assert "start_location" not in query("//a", docs, include_location=False).columns
    with pytest.raises(ValueError):
        query("//a", docs, output="other")
    with pytest.raises(ValueError):
        query("//a", docs, columns=["other"])


def test_documents_without_content_and_keys_of_any_type(spark):
    docs = spark.createDataFrame([("k1", "<a/>"), ("k2", None), ("k3", " \n"), (None, "<a/>"), ("k1", "<a/>")], "id string, html string")
    assert sorted(r.id for r in query("//a", docs, key="id", columns=["node_name"]).collect()) == ["k1", "k1"]
    assert sorted(r.id for r in errors(docs, "id").collect()) == ["k2", "k3"]
    empty = docs.where("false")
    assert query("//a[b]", empty, key="id").count() == 0


def test_one_shredding_serves_many_queries(spark):
    docs = spark.createDataFrame([(1, LIST), (2, "<li>9</li>")], "doc_id int, html string")
    table = shred_documents(docs)
    rows = query_many({"items": "//li", "lists": "//u"}, table, columns=["text_content"]).collect()
    assert sorted((r.query_name, r.doc_id, r.text_content) for r in rows) == [("items", 1, "1"), ("items", 1, "2"), ("items", 1, "3"), ("items", 2, "9"), ("lists", 1, "1"), ("lists", 1, "23")]
    x = compile_xpath("//li[last()]")
    assert x.expression == "//li[last()]" and "Window" in x.explain(table)
    table.unpersist()


def test_implicit_tables_can_be_released_before_the_result_is_read(spark):
    docs = spark.createDataFrame([(1, LIST)], "doc_id int, html string")
    found = query("//u[li='2']", docs, columns=["text_content"])
    release()
    assert [r.text_content for r in found.collect()] == ["23"]
    assert [r.text_content for r in query("//u[li='1']", docs, columns=["text_content"]).collect()] == ["1"]


def test_joins_on_a_node_table_move_nothing_but_the_shredding(spark):
    docs = spark.createDataFrame([(i, LIST) for i in range(50)], "doc_id int, html string")
    table = shred_documents(docs)
    table.df.count()
    plan = query("//u[li='2']/li[not(b)][last()]", table)._jdf.queryExecution().executedPlan().toString()
    above = plan.split("InMemoryRelation")[0]
    assert "Exchange" not in above, above
    table.unpersist()


def test_source_slices_json_and_entities(spark):
    docs = spark.createDataFrame([(1, "<a>世<b>&lt;界</b></a>")], "doc_id int, html string")
    found = query("//b", docs)
    assert found.join(docs, "doc_id").select(slice_source("html").alias("s")).first()["s"] == "<b>&lt;界</b>"
    assert found.select(unescape_entities(F.col("text_content")).alias("t")).first()["t"] == "<界"
    out = json.loads(to_json_documents(found).first()["json"])
    assert out["count"] == 1 and out["results"][0]["node_name"] == "b" and out["error"] is None
    more = docs.unionByName(spark.createDataFrame([(2, "<x/>"), (3, " ")], docs.schema))
    every = {r.doc_id: json.loads(r.json) for r in to_json_documents(query("//b", more), docs=more).collect()}
    assert [every[i]["count"] for i in (1, 2, 3)] == [1, 0, 0] and every[2]["results"] == [] and every[2]["error"] is None and every[3]["error"]


def test_sql_table_function(spark):
    register_table(spark, spark.createDataFrame([(1, "<a>x</a>")], "id int, html string"), "docs_for_sql")
    rows = spark.sql("SELECT d.id, n.text FROM docs_for_sql d, LATERAL html_nodes(d.html) n WHERE n.name = 'a'").collect()
    assert [tuple(r) for r in rows] == [(1, "x")]


def test_files(spark, tmp_path):
    (tmp_path / "one.html").write_text("<p>é</p>\n<p>2</p>", encoding="utf-8")
    docs = read_documents(spark, str(tmp_path))
    assert sorted(r.text_content for r in query("//p", docs, columns=["text_content"]).collect()) == ["2", "é"]


def test_versions():
    assert is_compatible(__version__) and not is_compatible("99.0.0") and not is_compatible("x")
    assert check_spark_version() and build_info()["version"] == __version__
