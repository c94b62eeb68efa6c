"""The registered query pack: every operator of the engine over the driver's tables, each with an equivalent SQL query.

Two families. Over ``pages``, raw markup is queried directly and the SQL side uses
regular expressions. The rest render relational rows to markup, query that, and
compare with plain SQL over the rows: customers with their orders, users with
their events, conversations with their turns, regions with nations and customers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import compile_xpath, errors, query, query_many, register_table, shred_documents, slice_source, to_json_documents
from .functions.values import unescape_entities
from .version import API_VERSION, is_compatible

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _attribute(name: str, value: Column) -> Column:
    return F.concat(F.lit(f' {name}="'), value.cast("string"), F.lit('"'))


def _by_key(df: DataFrame, key: str) -> DataFrame:
    """Rows of a document together, in enough partitions for the parse that follows: grouping by ``key`` then moves nothing more."""
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def _joined(items: str) -> Column:
    """Child markup in key order, from a list of (key, markup)."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(items)), lambda x: x["m"]), "")


def customer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One per customer, with its orders by key."""
    orders = _table(spark, sf_dir, "orders")
    order = F.concat(
        F.lit("<order"), _attribute("id", F.col("o_orderkey")), _attribute("status", F.col("o_orderstatus")), _attribute("pri", F.col("o_orderpriority")),
        _attribute("total", F.col("o_totalprice").cast("decimal(15,2)")), F.lit("/>"),
    )
    lists = orders.select(F.col("o_custkey").alias("c_custkey"), F.struct(F.col("o_orderkey").alias("k"), order.alias("m")).alias("x"))
    lists = _by_key(lists, "c_custkey").groupBy("c_custkey").agg(_joined("x").alias("inner"))
    customer = F.concat(
        F.lit("<customer"), _attribute("id", F.col("c_custkey")), _attribute("seg", F.col("c_mktsegment")), _attribute("nation", F.col("c_nationkey")), F.lit(">"),
        F.coalesce("inner", F.lit("")), F.lit("</customer>"),
    )
    return _table(spark, sf_dir, "customer").join(lists, "c_custkey", "left").select("c_custkey", customer.alias("html"))


def user_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One per user, with events by id."""
    event = F.concat(F.lit("<event"), _attribute("id", F.col("event_id")), _attribute("type", F.col("event_type")), F.lit("/>"))
    events = _table(spark, sf_dir, "events").select("user_id", F.struct(F.col("event_id").alias("k"), event.alias("m")).alias("x"))
    inner = _by_key(events, "user_id").groupBy("user_id").agg(_joined("x").alias("inner"))
    return inner.select("user_id", F.concat(F.lit("<user"), _attribute("id", F.col("user_id")), F.lit(">"), "inner", F.lit("</user>")).alias("html"))


def chat_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One per conversation, with turns in order; ``<`` in their text is escaped."""
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("<"), F.lit("&lt;"))
    turn = F.concat(F.lit("<turn"), _attribute("n", F.col("turn")), _attribute("role", F.col("role")), F.lit(">"), text, F.lit("</turn>"))
    turns = _table(spark, sf_dir, "conversations").select("conv_id", F.struct(F.col("turn").alias("k"), turn.alias("m")).alias("x"))
    inner = _by_key(turns, "conv_id").groupBy("conv_id").agg(_joined("x").alias("inner"))
    return inner.select("conv_id", F.concat(F.lit("<conv>"), "inner", F.lit("</conv>")).alias("html"))


def region_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One per region: nations by key, in them customers by key. (Test markup: such a document grows with its region.)"""
    cust = F.concat(F.lit("<cust"), _attribute("id", F.col("c_custkey")), _attribute("seg", F.col("c_mktsegment")), F.lit("/>"))
    custs = _table(spark, sf_dir, "customer").select("c_nationkey", F.struct(F.col("c_custkey").alias("k"), cust.alias("m")).alias("x"))
    custs = _by_key(custs, "c_nationkey").groupBy("c_nationkey").agg(_joined("x").alias("inner"))
    nations = _table(spark, sf_dir, "nation").join(custs, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    nation = F.concat(F.lit("<nation"), _attribute("id", F.col("n_nationkey")), F.lit(">"), F.coalesce("inner", F.lit("")), F.lit("</nation>"))
    nations = nations.select("n_regionkey", F.struct(F.col("n_nationkey").alias("k"), nation.alias("m")).alias("y"))
    nations = nations.groupBy("n_regionkey").agg(_joined("y").alias("inner"))
    regions = _table(spark, sf_dir, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"))
    return regions.select("r_regionkey", F.concat(F.lit("<region"), _attribute("name", F.col("r_name")), F.lit(">"), "inner", F.lit("</region>")).alias("html"))


def _register(name: str, run: Query, sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def _pages(name: str, xpath: str, columns: str, sql: str | None, **options: object) -> None:
    """``columns`` of every match in ``pages``; the SQL side's ``h`` is the page's html."""
    names = columns.split()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(xpath, _table(spark, sf_dir, "pages"), key="page_id", columns=names, **options)

    _register(name, run, sql)


def _counted(name: str, xpath: str, sql: str) -> None:
    """The number of matches a page."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = query(xpath, _table(spark, sf_dir, "pages"), key="page_id", columns=["node_type"])
        return found.groupBy("page_id").agg(F.count("*").alias("n"))

    _register(name, run, sql)


def _ids(name: str, build: Query, key: str, out: str, xpath: str, sql: str, attribute: str = "id", kind: str = "long", **options: object) -> None:
    """An attribute of every matching element, with the key of its document."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = query(xpath, build(spark, sf_dir), key=key, columns=["attributes"], **options)
        value = F.col("attributes")[attribute].cast(kind)
        return found.select(*([key] if key != out else []), value.alias(out))

    _register(name, run, sql)


def _orders(name: str, xpath: str, sql: str) -> None:
    _ids(name, customer_documents, "c_custkey", "o_orderkey", xpath, "SELECT o_custkey AS c_custkey, o_orderkey FROM " + sql)


def _customers(name: str, xpath: str, sql: str) -> None:
    _ids(name, customer_documents, "c_custkey", "c_custkey", xpath, "SELECT c_custkey FROM customer WHERE " + sql)


def _events(name: str, xpath: str, sql: str) -> None:
    _ids(name, user_documents, "user_id", "event_id", xpath, sql)


def _turns(name: str, xpath: str, condition: str) -> None:
    sql = f"SELECT conv_id, turn AS n FROM (SELECT conv_id, turn, role, replace(coalesce(text, ''), '<', '&lt;') AS t FROM conversations) WHERE {condition}"
    _ids(name, chat_documents, "conv_id", "n", xpath, sql, attribute="n")


# -- pages: steps, positions, offsets, raw text, recovery

_EACH = "SELECT page_id, CAST(generate_subscripts(l, 1) AS INTEGER) AS ord, unnest(l) AS text_content FROM (SELECT page_id, {} AS l FROM pages)"
_NAV = "regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1)"
_LINKS = f"regexp_extract_all({_NAV}, '<li><a href=\"[^\"]*\">(.*?)</a></li>', 1)"

_pages("xpath_descendant_name", "//h1", "ord text_content", "SELECT page_id, CAST(1 AS INTEGER) AS ord, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS text_content FROM pages")
_pages("xpath_absolute_path", "/html/head/title", "text_content", "SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS text_content FROM pages")
_pages("xpath_attribute_step", "//nav//a/@href", "ord text_content", _EACH.format(f"regexp_extract_all({_NAV}, '<a href=\"([^\"]*)\"', 1)"))
_pages("xpath_root_attribute", "/html/@lang", "node_name text_content", "SELECT page_id, 'lang' AS node_name, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS text_content FROM pages")
_pages("xpath_position_first", "//ul/li[1]", "text_content", f"SELECT page_id, {_LINKS}[1] AS text_content FROM pages WHERE len({_LINKS}) > 0")
_pages("xpath_position_last", "//ul/li[last()]", "text_content", f"SELECT page_id, {_LINKS}[-1] AS text_content FROM pages WHERE len({_LINKS}) > 0")
_pages("xpath_count_predicate", "//ul[count(li)=5]", "node_name", f"SELECT page_id, 'ul' AS node_name FROM pages WHERE len({_LINKS}) = 5")
_pages(
    "xpath_byte_offsets", "//h1", "start_location end_location",
    "SELECT page_id, CAST(s AS INTEGER) AS start_location, CAST(s + strlen(regexp_extract(html, '<h1>.*?</h1>')) AS INTEGER) AS end_location "
    "FROM (SELECT page_id, html, strlen(html[:strpos(html, '<h1>') - 1]) AS s FROM pages)",
)
_pages(
    "xpath_contents_only", "//title", "value start_location end_location",
    "SELECT page_id, t AS value, CAST(s AS INTEGER) AS start_location, CAST(s + strlen(t) AS INTEGER) AS end_location FROM "
    "(SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS t, strlen(html[:strpos(html, '<title>') - 1]) + 7 AS s FROM pages)",
    contents_only=True,
)
_pages("xpath_raw_text", "//script", "text_content", "SELECT page_id, regexp_extract(html, '(?s)<script>(.*?)</script>', 1) AS text_content FROM pages")
_pages("xpath_comment_nodes", "//comment()", "node_name text_content", "SELECT page_id, '#comment' AS node_name, regexp_extract(html, '<!--(.*?)-->', 1) AS text_content FROM pages")
_counted("xpath_void_elements", "//br", "SELECT page_id, len(regexp_extract_all(html, '<br>')) AS n FROM pages WHERE len(regexp_extract_all(html, '<br>')) > 0")
_counted("xpath_unclosed_elements", "//p", "SELECT page_id, len(regexp_extract_all(html, '<p>')) AS n FROM pages WHERE len(regexp_extract_all(html, '<p>')) > 0")
_pages(
    "xpath_union", "//h1 | //title", "ord node_name text_content",
    "SELECT page_id, CAST(1 AS INTEGER) AS ord, 'title' AS node_name, regexp_extract(html, '<title>(.*?)</title>', 1) AS text_content FROM pages "
    "UNION ALL SELECT page_id, CAST(2 AS INTEGER), 'h1', regexp_extract(html, '<h1>(.*?)</h1>', 1) FROM pages",
)
_pages("xpath_attribute_equality", "//div[@class='ad']", "text_content", "SELECT page_id, regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1) AS text_content FROM pages WHERE html LIKE '%<div class=\"ad\">%'")
_pages("xpath_full_value", "//h1", "value", "SELECT page_id, regexp_extract(html, '<h1>.*?</h1>') AS value FROM pages")
_pages("xpath_starts_with", "//a[starts-with(@href,'/t')]/@href", "text_content", f"SELECT page_id, t AS text_content FROM (SELECT page_id, unnest(regexp_extract_all({_NAV}, '<a href=\"([^\"]*)\"', 1)) AS t FROM pages) WHERE starts_with(t, '/t')")
_pages("xpath_grouped_position", "(//li)[2]", "text_content", f"SELECT page_id, {_LINKS}[2] AS text_content FROM pages WHERE len({_LINKS}) > 1")
_pages("xpath_parent_step", "//li/..", "node_name", f"SELECT page_id, 'ul' AS node_name FROM pages WHERE len({_LINKS}) > 0")
_pages("xpath_doctype_and_text", "/node()", "node_type", "SELECT page_id, unnest([10, 1]) AS node_type FROM pages")
_pages("xpath_output_paths", "//nav/ul", "value", f"SELECT page_id, '/#document/html/body/nav/ul' AS value FROM pages WHERE len({_LINKS}) > 0", output="paths")
_pages("xpath_output_values", "//nav/ul/li/a", "value", "SELECT page_id, unnest(l) AS value FROM (SELECT page_id, " + _LINKS + " AS l FROM pages)", output="values")
_pages("xpath_scalar_count", "count(//li)", "value", f"SELECT page_id, CAST(len({_LINKS}) AS VARCHAR) AS value FROM pages")
_pages("xpath_scalar_string", "string(//title)", "value", "SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS value FROM pages")
_pages("xpath_scalar_boolean", "count(//li) > 5 and not(//h2)", "value", f"SELECT page_id, CASE WHEN len({_LINKS}) > 5 THEN 'true' ELSE 'false' END AS value FROM pages")


def _sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    found = query("//nav", pages, key="page_id", columns=["start_location", "end_location"])
    return found.join(pages, "page_id").select("page_id", slice_source("html").alias("markup"))


_register("xpath_source_slice", _sliced, "SELECT page_id, regexp_extract(html, '(?s)<nav>.*?</nav>') AS markup FROM pages")


def _several(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = {"title": "//title", "heading": "//h1", "language": "/html/@lang"}
    return query_many(named, _table(spark, sf_dir, "pages"), key="page_id", columns=["text_content"])


_register(
    "xpath_query_many", _several,
    "SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS text_content, 'title' AS query_name FROM pages "
    "UNION ALL SELECT page_id, regexp_extract(html, '<h1>(.*?)</h1>', 1), 'heading' FROM pages "
    "UNION ALL SELECT page_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1), 'language' FROM pages",
)


def _lateral(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_table(spark, _table(spark, sf_dir, "pages"), "markup_pages")
    return spark.sql("SELECT p.page_id, n.text AS text_content FROM markup_pages p, LATERAL html_nodes(p.html) n WHERE n.kind = 1 AND n.name = 'h1'")


_register("sql_lateral_nodes", _lateral, "SELECT page_id, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS text_content FROM pages")

# -- customers and orders: predicates, arithmetic, positions, semi and anti joins, counts

_RANKED = "(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS b FROM orders)"
_orders("xpath_order_status", "//order[@status='F']", "orders WHERE o_orderstatus = 'F'")
_orders("xpath_numeric_compare", "//order[@total>200000]", "orders WHERE o_totalprice > 200000")
_orders("xpath_and_or_not", "//order[(@status='F' or @status='P') and not(@pri='1-URGENT')]", "orders WHERE o_orderstatus IN ('F', 'P') AND o_orderpriority <> '1-URGENT'")
_orders("xpath_arithmetic", "//order[@total div 1000 + 10 > 150 - 2 * 5]", "orders WHERE o_totalprice / 1000 + 10 > 150 - 2 * 5")
_orders("xpath_mod", "//order[@id mod 7 = 0]", "orders WHERE o_orderkey % 7 = 0")
_orders("xpath_position_range", "//order[position()<=3]", f"{_RANKED} WHERE r <= 3")
_orders("xpath_position_mod", "//order[position() mod 2 = 0]", f"{_RANKED} WHERE r % 2 = 0")
_orders("xpath_last_minus_one", "//order[last()-1]", f"{_RANKED} WHERE b = 2")
_orders("xpath_chained_predicates", "//order[@status='O'][2]", "(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders WHERE o_orderstatus = 'O') WHERE r = 2")
_orders("xpath_reversed_chain", "//order[2][@status='O']", f"{_RANKED} WHERE r = 2 AND o_orderstatus = 'O'")
_orders("xpath_position_or_value", "//order[position()=1 or @total<1000]", f"{_RANKED} WHERE r = 1 OR o_totalprice < 1000")
_orders("xpath_relative_start", "order[@status!='O']", "orders WHERE o_orderstatus <> 'O'")
_customers("xpath_child_exists", "//customer[order]", "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_customers("xpath_filtered_child_absent", "//customer[not(order[@status='P'])]", "NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
_customers("xpath_nested_predicate", "//customer[order[@status='F']]", "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
_customers("xpath_count_compare", "//customer[count(order)>10]", "(SELECT count(*) FROM orders WHERE o_custkey = c_custkey) > 10")
_customers("xpath_count_filtered", "//customer[count(order[@status='F'])>=5]", "(SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') >= 5")
_customers("xpath_first_node_compare", "//customer[order/@status='F']", "(SELECT min_by(o_orderstatus, o_orderkey) FROM orders WHERE o_custkey = c_custkey) = 'F'")
_customers("xpath_nested_last", "//customer[order[last()]/@status='O']", "(SELECT max_by(o_orderstatus, o_orderkey) FROM orders WHERE o_custkey = c_custkey) = 'O'")
_customers("xpath_exists_or", "//customer[order[@total>300000] or @seg='BUILDING']", "c_mktsegment = 'BUILDING' OR EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
_customers("xpath_union_predicate", "//customer[order[@status='P'] | order[@total<2000]]", "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND (o_orderstatus = 'P' OR o_totalprice < 2000))")
_customers("xpath_string_functions", "//customer[starts-with(@seg,'B') and contains(@seg,'ILD') and string-length(@seg)=8]", "starts_with(c_mktsegment, 'B') AND contains(c_mktsegment, 'ILD') AND strlen(c_mktsegment) = 8")
_customers("xpath_substring", "//customer[substring(@seg,1,3)='MAC' or substring-after(@seg,'AUTO')='MOBILE' or substring-before(@seg,'SE')='HOU']", "substr(c_mktsegment, 1, 3) = 'MAC' OR c_mktsegment = 'AUTOMOBILE' OR starts_with(c_mktsegment, 'HOUSE')")
_customers("xpath_concat_name", "//*[concat(name(),'-',@seg)='customer-BUILDING']", "c_mktsegment = 'BUILDING'")
_customers("xpath_wildcard_attribute", "//*[@seg]", "true")
_customers("xpath_number_boolean", "//customer[number(@nation)=3 or boolean(@missing)]", "c_nationkey = 3")


_customers("xpath_node_function", "//customer[node()]", "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_customers("xpath_boolean_of_nodes", "//customer[boolean(order) and true()]", "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_customers("xpath_hex_float", "//customer[number('0x1.8p1') = @nation]", "c_nationkey = 3")
_customers("xpath_byte_length", "//customer[string-length('é')=2 and substring('aé',1,3)='aé' and @seg='BUILDING']", "c_mktsegment = 'BUILDING'")
_customers("xpath_first_child_value", "//customer[order[2]/@status='F']", f"EXISTS (SELECT 1 FROM {_RANKED} WHERE r = 2 AND o_custkey = c_custkey AND o_orderstatus = 'F')")
_orders("xpath_any_attribute", "//customer/*[@*]", "orders")
_orders("xpath_false", "//order[false() or @status='F']", "orders WHERE o_orderstatus = 'F'")
_orders("xpath_unary_minus", "//order[-@total < -200000]", "orders WHERE o_totalprice > 200000")
_orders("xpath_not_a_number", "//order[not(number(@pri) = number(@pri)) and @status='P']", "orders WHERE o_orderstatus = 'P'")
_orders("xpath_namespace_uri", "//order[namespace-uri()='' and local-name()='order']", "orders")


def _scalar(name: str, xpath: str, value: str) -> None:
    """A scalar a customer; ``value`` over columns of customer and ``n``, the number of orders."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(xpath, customer_documents(spark, sf_dir), key="c_custkey", columns=["value"])

    _register(name, run, f"SELECT c_custkey, {value} AS value FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")


_scalar("xpath_namespace_axis", "count(//order/namespace::*)", "'0'")
_scalar("xpath_number_format", "count(//order) + 1 div 4", "CAST(coalesce(n, 0) AS VARCHAR) || '.25'")
_scalar("xpath_nan_string", "string(number('x'))", "'NaN'")


def _customer_markup(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    """One document per customer: ``parts`` with its key for each ``{}``."""
    pieces = [F.lit(p) if p != "{}" else F.col("c_custkey").cast("string") for p in parts]
    return _table(spark, sf_dir, "customer").select("c_custkey", F.concat(*pieces).alias("html"))


def _markup(name: str, parts: tuple[str, ...], xpath: str, columns: str, values: str, **options: object) -> None:
    """``columns`` of the matches in one such document, which are ``values`` in SQL (``k`` is the key as a string)."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(xpath, _customer_markup(spark, sf_dir, *parts), key="c_custkey", columns=columns.split(), **options)

    _register(name, run, f"SELECT c_custkey, {values} FROM (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS k FROM customer)")


_markup("xpath_malformed_tag", ("<c><b =bad><ok n='", "{}", "'>t</ok>"), "/c/ok/@n", "text_content", "k AS text_content")
_markup("xpath_wrong_closing_tag", ("<c><b>x", "{}", "</i>y</b></c>"), "//b", "text_content", "'x' || k || '</i>y' AS text_content")
_markup("xpath_unclosed_to_the_end", ("<c><b>x<i>", "{}"), "/c/b/i", "text_content end_location", "k AS text_content, CAST(10 + strlen(k) AS INTEGER) AS end_location")
_markup("xpath_attribute_quotes", ("<c a='1' b=\"", "{}", "\" d=e f a=2 />"), "/c[@a='2' and @d='e' and @f='']/@b", "text_content", "k AS text_content")
_markup("xpath_processing_instruction", ("<c><?p ", "{}", "?><?q z?></c>"), "//processing-instruction('p')", "node_type text_content", "CAST(7 AS INTEGER) AS node_type, 'p ' || k AS text_content")
_markup("xpath_prefixed_name", ("<m:c><m:d>", "{}", "</m:d></m:c>"), "//m:c/m:d[local-name()='d' and name()='m:d']", "text_content", "k AS text_content")
_markup("xpath_without_locations", ("<c>", "{}", "</c>"), "//c", "ord text_content start_location", "CAST(1 AS INTEGER) AS ord, k AS text_content", include_location=False)


def _json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = customer_documents(spark, sf_dir)
    return to_json_documents(query("//order[1]/@id", docs, key="c_custkey", columns=["ord", "text_content"]), key="c_custkey", docs=docs)


_register(
    "json_documents", _json_documents,
    "SELECT c_custkey, CASE WHEN o_orderkey IS NULL THEN '{\"results\":[],\"count\":0,\"error\":null}' ELSE "
    "'{\"results\":[{\"ord\":1,\"text_content\":\"' || CAST(o_orderkey AS VARCHAR) || '\"}],\"count\":1,\"error\":null}' END AS json "
    f"FROM customer LEFT JOIN (SELECT * FROM {_RANKED} WHERE r = 1) ON o_custkey = c_custkey",
)


def _document_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") == 3, " \n").when(F.col("c_nationkey") > 3, "<<c").alias("html"))
    return errors(docs, key="c_custkey")


_register("document_errors", _document_errors, "SELECT c_custkey, 'the document is empty' AS error FROM customer WHERE c_nationkey <= 3")

_CHECKED = {"//a[1]": True, "//a[": False, "//a]": False, "a b": False, "$x": False, "sideways::a": False, "frobnicate(1)": False, "count()": False, "//a[@b='c]": False, "": False}


def _syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    def valid(expression: str) -> bool:
        try:
            compile_xpath(expression)
        except ValueError:
            return False
        return True

    return spark.createDataFrame([(x, valid(x), compile_xpath(x).expression if valid(x) else None) for x in _CHECKED], "expression string, valid boolean, compiled string")


_register("xpath_syntax_check", _syntax, "SELECT * FROM (VALUES " + ", ".join(f"('{x.replace(chr(39), chr(39) * 2)}', {str(v).lower()}, {chr(39) + x + chr(39) if v else 'NULL'})" for x, v in _CHECKED.items()) + ") AS t(expression, valid, compiled)")


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(API_VERSION, is_compatible("0.1"), is_compatible("1.0"))], "api_version string, same boolean, later boolean")


_register("library_version", _versions, "SELECT '1' AS api_version, true AS same, false AS later")


def _unpivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query("//order[1]/@*", customer_documents(spark, sf_dir), key="c_custkey", columns=["node_name", "text_content"])


_register(
    "xpath_all_attributes", _unpivoted,
    "SELECT c_custkey, unnest(['id', 'status', 'pri', 'total']) AS node_name, unnest([CAST(o_orderkey AS VARCHAR), o_orderstatus, o_orderpriority, "
    f"CAST(CAST(o_totalprice AS DECIMAL(15, 2)) AS VARCHAR)]) AS text_content FROM (SELECT o_custkey AS c_custkey, * FROM {_RANKED}) WHERE r = 1",
)


def _sibling_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query("//order", customer_documents(spark, sf_dir), key="c_custkey", columns=["ord", "path"])


_register(
    "xpath_sibling_paths", _sibling_paths,
    "SELECT o_custkey AS c_custkey, CAST(r AS INTEGER) AS ord, '/#document/customer/order' || CASE WHEN r + b > 2 THEN '[' || CAST(r AS VARCHAR) || ']' ELSE '' END AS path FROM " + _RANKED,
)


def _document_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = shred_documents(customer_documents(spark, sf_dir), "c_custkey", "html", ["pre", "parent", "kind", "name", "attrs"])
    nodes = table.df.where("kind = 1 AND name = 'order'")
    return nodes.groupBy(F.col("attrs")["status"].alias("status")).agg(F.count("*").alias("n"), F.countDistinct("doc").alias("docs"))


_register("node_table_aggregate", _document_totals, "SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT o_custkey) AS docs FROM orders GROUP BY 1")

# -- users and events: sibling axes, grouped positions, distinct

_EV = "(SELECT user_id, event_id, event_type, lag(event_type) OVER w AS before, row_number() OVER w AS r, count(*) OVER (PARTITION BY user_id) AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))"
_events("xpath_following_sibling", "//event[@type='error']/following-sibling::event[1]", f"SELECT user_id, event_id FROM {_EV} WHERE before = 'error'")
_events(
    "xpath_preceding_sibling", "//event[@type='signup']/preceding-sibling::event",
    "SELECT user_id, event_id FROM events e WHERE event_id < (SELECT max(event_id) FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'signup')",
)
_events("xpath_sibling_predicate", "//event[following-sibling::event]", f"SELECT user_id, event_id FROM {_EV} WHERE r < n")
_events("xpath_sibling_absent", "//event[not(preceding-sibling::event[@type='error'])]", "SELECT user_id, event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'error' AND s.event_id < e.event_id)")
_events("xpath_next_type", "//event[following-sibling::event[1]/@type='error']", f"SELECT user_id, event_id FROM (SELECT *, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS next FROM events) WHERE next = 'error'")
_events("xpath_second_error_after", "//event[@type='signup']/following-sibling::event[@type='error'][2]", "SELECT DISTINCT user_id, e.event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events WHERE event_type = 'error') e JOIN (SELECT user_id, (SELECT count(*) FROM events x WHERE x.user_id = s.user_id AND x.event_type = 'error' AND x.event_id < s.event_id) AS b FROM events s WHERE event_type = 'signup') USING (user_id) WHERE r = b + 2")
_events("xpath_errors_before", "//event[count(preceding-sibling::event[@type='error'])=1]", "SELECT user_id, event_id FROM events e WHERE (SELECT count(*) FROM events x WHERE x.user_id = e.user_id AND x.event_type = 'error' AND x.event_id < e.event_id) = 1")
_events("xpath_third_overall", "(//event)[3]", f"SELECT user_id, event_id FROM {_EV} WHERE r = 3")
_events("xpath_sibling_count", "//event[count(preceding-sibling::event)=4]", f"SELECT user_id, event_id FROM {_EV} WHERE r = 5")
_ids("xpath_parent_distinct", user_documents, "user_id", "user_id", "//event[@type='error']/parent::user", "SELECT DISTINCT user_id FROM events WHERE event_type = 'error'")
_ids("xpath_self_axis", user_documents, "user_id", "event_id", "//event/self::event[@type='click']", "SELECT user_id, event_id FROM events WHERE event_type = 'click'")

# -- conversations: text functions

_turns("xpath_role_prefix", "//turn[starts-with(@role,'a')]", "starts_with(role, 'a')")
_turns("xpath_text_contains", "//turn[contains(.,'the')]", "contains(t, 'the')")
_turns("xpath_text_length", "//turn[string-length(text())>200]", "strlen(t) > 200")
_turns("xpath_normalize_space", "//turn[normalize-space(.)=.]", "trim(regexp_replace(t, '[ \\t\\r\\n]+', ' ', 'g')) = t")
_turns("xpath_role_substring", "//turn[substring(@role,1,2)='us']", "substr(role, 1, 2) = 'us'")
_turns("xpath_role_concat", "//turn[concat(@role,'-x')='user-x']", "role = 'user'")
_ids("xpath_odd_turns", chat_documents, "conv_id", "n", "//turn[@role='user'][position() mod 2 = 1]", "SELECT conv_id, turn AS n FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE role = 'user') WHERE r % 2 = 1", attribute="n")


def _text_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query("//turn/text()", chat_documents(spark, sf_dir), key="conv_id", columns=["text_content"])


_register("xpath_text_step", _text_step, "SELECT conv_id, replace(text, '<', '&lt;') AS text_content FROM conversations WHERE text <> ''")


def _unescaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_step(spark, sf_dir).select("conv_id", unescape_entities(F.col("text_content")).alias("text"))


_register(
    "entities_decoded", _unescaped,
    "SELECT conv_id, replace(replace(replace(replace(replace(replace(replace(text, '<', '&lt;'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', chr(39)), '&nbsp;', chr(160)), '&amp;', '&') AS text "
    "FROM conversations WHERE text <> ''",
)


def _with_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query("//turn[@role='system']/..", chat_documents(spark, sf_dir), key="conv_id", columns=["node_name"])


_register("xpath_parent_abbreviated", _with_system, "SELECT DISTINCT conv_id, 'conv' AS node_name FROM conversations WHERE role = 'system'")

# -- regions, nations and customers: ancestors, descendants, following and preceding

_GEO = "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _geo(name: str, xpath: str, sql: str, attribute: str = "id", out: str = "id", kind: str = "long") -> None:
    _ids(name, region_documents, "r_regionkey", out, xpath, sql, attribute=attribute, kind=kind)


_geo("xpath_ancestor", "//cust[@seg='BUILDING']/ancestor::region", f"SELECT DISTINCT r_regionkey, r_name AS name FROM {_GEO} WHERE c_mktsegment = 'BUILDING'", "name", "name", "string")
_geo("xpath_ancestor_predicate", "//cust[ancestor::region[@name='ASIA']]", f"SELECT r_regionkey, c_custkey AS id FROM {_GEO} WHERE r_name = 'ASIA'")
_geo("xpath_ancestor_position", "//cust/ancestor::*[1]", f"SELECT DISTINCT r_regionkey, n_nationkey AS id FROM {_GEO}")
_geo("xpath_descendant_axis", "//region/descendant::cust", f"SELECT r_regionkey, c_custkey AS id FROM {_GEO}")
_geo("xpath_descendant_or_self", "//nation/descendant-or-self::*[@id]", f"SELECT r_regionkey, c_custkey AS id FROM {_GEO} UNION ALL SELECT n_regionkey, n_nationkey FROM nation")
_geo("xpath_ancestor_or_self", "//nation/ancestor-or-self::nation", "SELECT n_regionkey AS r_regionkey, n_nationkey AS id FROM nation")
_geo("xpath_following", "//nation[1]/following::nation", "SELECT r_regionkey, id FROM (SELECT n_regionkey AS r_regionkey, n_nationkey AS id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation) WHERE r > 1")
_geo("xpath_preceding", "//nation[last()]/preceding::nation", "SELECT r_regionkey, id FROM (SELECT n_regionkey AS r_regionkey, n_nationkey AS id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) AS r FROM nation) WHERE r > 1")
_geo("xpath_descendant_count", "//nation[count(.//cust[@seg='BUILDING'])>10]", f"SELECT r_regionkey, n_nationkey AS id FROM {_GEO} WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2 HAVING count(*) > 10")
_geo("xpath_mid_descendants", "/region//cust[@seg='MACHINERY']", f"SELECT r_regionkey, c_custkey AS id FROM {_GEO} WHERE c_mktsegment = 'MACHINERY'")
_geo("xpath_following_exists", "//nation[following::nation]", "SELECT n_regionkey AS r_regionkey, n_nationkey AS id FROM nation n WHERE EXISTS (SELECT 1 FROM nation m WHERE m.n_regionkey = n.n_regionkey AND m.n_nationkey > n.n_nationkey)")
_geo("xpath_preceding_count", "//nation[count(preceding::nation)=2]", "SELECT r_regionkey, id FROM (SELECT n_regionkey AS r_regionkey, n_nationkey AS id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation) WHERE r = 3")
_geo("xpath_absolute_in_predicate", "//nation[/region[@name='EUROPE']]", "SELECT n_regionkey AS r_regionkey, n_nationkey AS id FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'")
