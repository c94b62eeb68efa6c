"""The tolerant parser: tree shapes, byte spans, recovery, and that it always ends."""

from hypothesis import given, settings
from hypothesis import strategies as st

from markgrove.api import errors, query
from markgrove.sources import shred
from markgrove.sources.markup import FIELDS, parse
from markgrove.sources.shred import _map_array, document_columns


def shape(html):
    """(name, depth) of all nodes but the document."""
    c = document_columns(html)
    return list(zip(c["name"], c["depth"], strict=True))[1:]


def elements(html):
    c = document_columns(html)
    return [(n, s, e, a, b) for n, k, s, e, a, b in zip(c["name"], c["kind"], c["start"], c["end"], c["content_start"], c["content_end"], strict=True) if k == 1]


def test_malformed_link_is_dropped_and_siblings_stay():
    html = '<html><body><div><link rel="x" href="y" <="" head=""><ul><li>1</li></ul><ul><span>2</span></ul></div></body></html>'
    assert [n for n, _ in shape(html) if n != "#text"] == ["html", "body", "div", "ul", "li", "ul", "span"]


def test_malformed_item_keeps_valid_items_and_its_stray_end_tag_is_text():
    c = document_columns('<ul><li>a</li><li <=""></li><li>c</li></ul>')
    assert c["name"].count("li") == 2
    assert c["text"][1] == "a</li>c"


def test_resynchronisation_after_a_malformed_span():
    assert [n for n, _ in shape('<div><span <=""><div></div><p>keep</p></div>')] == ["div", "div", "p", "#text"]


def test_mismatched_end_tag_is_text_and_moves_the_content_end():
    c = document_columns("<p><b>x</p>")
    assert c["text"][2] == "x</p>" and (c["end"][2], c["content_end"][2]) == (11, 7)


def test_spans_are_bytes():
    assert elements("<p>世界</p>") == [("p", 0, 13, 3, 9)]


def test_void_and_self_closing_have_no_content():
    assert elements('<a>x<img src="t"/><br>y</a>')[1:] == [("img", 4, 18, 18, 18), ("br", 18, 22, 22, 22)]


def test_raw_text_ends_at_its_own_end_tag():
    c = document_columns('<script>a</b>"</p>"</SCRIPT ><p/>')
    assert c["text"][1] == 'a</b>"</p>"' and c["name"] == ["#document", "script", "#text", "p"]


def test_other_node_kinds():
    c = document_columns('<!DOCTYPE html><?xml v?><!--c--><r><![CDATA[x]]><p/></r>')
    assert c["kind"] == [9, 10, 7, 8, 1, 8, 1]
    assert c["node_value"][1:4] == ["<!DOCTYPE html>", "xml v", "c"]


def test_unterminated_comment_stops_two_bytes_early():
    assert document_columns("<!-- un")["node_value"][1:] == [" ", "un"]


def test_stray_end_tag_between_top_level_nodes():
    assert document_columns("</x>a<p/>")["node_value"][1:] == ["/x>a", ""]


def test_attributes():
    c = document_columns("<a X=1 x=2 B = 'q\"' c=/für/y d e=\"ü\" f=/>")
    assert dict(c["attrs"][1]) == {"x": "2", "b": 'q"', "c": "/für/y", "d": "", "e": "ü", "f": ""}
    assert c["attr_order"][1] == ["x", "b", "c", "d", "e", "f"]


def test_paths_number_like_named_siblings_only():
    c = document_columns("<r><p/><p/><q/></r>")
    assert c["path"] == ["/#document", "/#document/r", "/#document/r/p[1]", "/#document/r/p[2]", "/#document/r/q"]


def test_nul_and_deep_nesting():
    assert document_columns("\0<p>\0</p>")["text"][1:] == ["\0", "\0", "\0"]
    c = document_columns("<d>" * 3000 + "x")
    assert c["depth"][-1] == 3001 and c["text"][1] == "x"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<>/!-?=\"' ab\n世\0[]", max_size=60))
def test_always_ends_with_nested_spans(html):
    source = html.encode()
    rows, chunks = parse(source)
    columns = dict(zip(FIELDS, zip(*rows, strict=True), strict=True))
    for i in range(1, len(rows)):
        p = columns["parent"][i]
        assert 0 <= p < i and columns["start"][p] <= columns["start"][i] <= columns["end"][i] <= columns["end"][p] <= len(source)
        assert columns["last"][i] <= columns["last"][p]
    assert max(columns["text_to"]) <= sum(map(len, chunks))


def test_map_columns_keep_nulls_and_empty_maps():
    assert [None if r is None else dict(r) for r in _map_array([None, {}, {"a": "1", "b": ""}, None]).to_pylist()] == [None, {}, {"a": "1", "b": ""}, None]


def test_unwanted_nodes_are_dropped_after_numbering():
    html = "<u><li a='1'>x</li>t<!--c--><b/><li/></u>"
    whole = document_columns(html)
    for wanted, names in ((frozenset(["li"]), ["li", "li"]), (frozenset(["@a", "b"]), ["li", "b"]), (frozenset(["*"]), ["u", "li", "b", "li"]), (frozenset(["text()", "#document"]), ["#document", "#text", "#text"])):
        some = document_columns(html, wanted=wanted)
        assert some["name"] == names
        for column, values in some.items():
            assert list(values) == [whole[column][i] for i in some["pre"]], column


def test_deep_nesting_is_read_in_parts_of_bounded_size(monkeypatch):
    """Unclosed elements nest: texts and sources together are as large as the square of the page."""
    html = "".join(f"<p>{i}" for i in range(4000))
    monkeypatch.setattr(shred, "BATCH_BYTES", 1 << 20)
    parts = list(shred.document_chunks(html))
    sizes = [sum(map(len, p["text"])) + sum(map(len, p["source"])) + sum(map(len, p["path"])) + 4 * sum(map(len, p["anc"])) for p in parts]
    assert max(sizes) < 3 << 20 and sum(sizes) > 50 << 20
    pre = [i for p in parts for i in p["pre"]]
    assert pre == list(range(8001))
    last = parts[-1]
    assert last["anc"][-1] == [0, *range(1, 8000, 2)] and last["path"][-1] == "/#document" + "/p" * 4000 + "/#text"


def test_parts_equal_the_whole(monkeypatch):
    html = "".join(f"<a x='{i}'>t<b>u<c>{i}</c>" + "</b>" * (i % 2) for i in range(150))
    whole = shred.document_columns(html)
    monkeypatch.setattr(shred, "BATCH_BYTES", 5000)
    monkeypatch.setattr(shred, "KEPT_DEPTH", 3)
    assert len(list(shred.document_chunks(html))) > 5 and shred.document_columns(html) == whole


def test_large_nested_page_in_a_query(spark):
    df = spark.createDataFrame([(1, "<p>x" * 250_000 + "<h1>end"), (2, "<h1>a</h1>")], "doc_id long, html string")
    rows = query("//h1", df, columns=["text_content", "start_location"]).collect()
    assert {(r.doc_id, r.text_content, r.start_location) for r in rows} == {(1, "end", 1_000_000), (2, "a", 0)}
    assert query("count(//p//p)", df, columns=["value"]).where("doc_id = 1").collect()[0].value == "249999"


def test_a_document_that_cannot_be_parsed_is_an_error_and_not_a_failure(monkeypatch):
    def broken(source):
        raise RuntimeError("no nodes here")

    assert shred.document_error(" ") == shred.document_error(None) == "the document is empty" and shred.document_error("<a>") is None
    monkeypatch.setattr(shred, "parse", broken)
    assert shred.document_error("<a>") == "RuntimeError: no nodes here"


def test_errors_list_blank_documents(spark):
    df = spark.createDataFrame([(1, "<a/>"), (2, None), (3, " \n"), (4, "<<<")], "doc_id long, html string")
    assert sorted((r.doc_id, r.error) for r in errors(df).collect()) == [(2, "the document is empty"), (3, "the document is empty")]
