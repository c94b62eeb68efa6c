"""The public surface: shred documents, compile expressions, query one or many, in batch."""

from __future__ import annotations

import logging
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .plans.ast import Expr
from .plans.compiler import Compiler, is_nodes
from .plans.parser import parse_xpath
from .sources.shred import CHAIN_FIELD, NODE_COLUMNS, NODE_FIELDS, Chain, parse_errors, register_table_function, shred

log = logging.getLogger("markgrove")
_TRACE = {"on": False}


def enable_trace(on: bool = True) -> None:
    """Log how each expression is parsed, which rewrites apply and what its plan reads (logger ``markgrove``, level INFO)."""
    _TRACE["on"] = on


def disable_trace() -> None:
    enable_trace(False)


def trace(message: str, *args: object) -> None:
    if _TRACE["on"]:
        log.info(message, *args)

#: Columns of a result after the document's key.
RESULT_COLUMNS = (
    "ord", "value", "node_name", "node_type", "attributes", "start_location", "end_location", "content_start", "content_end", "path", "text_content",
)
_LOCATIONS = ("start_location", "end_location", "content_start", "content_end")
FORMATS = ("nodes", "values", "paths")
#: Node columns behind each result column.
_BEHIND = {
    "ord": ["pre"], "value": [], "node_name": ["name"], "node_type": ["kind"], "attributes": ["attrs"], "start_location": [], "end_location": [],
    "content_start": ["content_start"], "content_end": ["content_end"], "path": ["path"], "text_content": ["text"],
}


class NodeTable:
    """Shredded documents, kept for several queries; partitioned by document, so their joins and windows move nothing."""

    def __init__(self, df: DataFrame, columns: Iterable[str]):
        self.df, self.columns = df, frozenset(columns)

    def unpersist(self) -> None:
        self.df.unpersist()


#: Tables that queries persisted by themselves, and how many of them at most.
_IMPLICIT: list[NodeTable] = []
IMPLICIT_TABLES = 4


def release() -> None:
    """Unpersist the node tables that ``query`` and ``evaluate`` kept because their plans read them more than once.

    The last IMPLICIT_TABLES of them stay until then, older ones go by themselves.
    Results that were not yet computed still can be, by parsing again.
    """
    while _IMPLICIT:
        _IMPLICIT.pop().unpersist()


def shred_documents(docs: DataFrame, key: str = "doc_id", html: str = "html", columns: Iterable[str] = NODE_COLUMNS, wanted: frozenset[str] | None = None,
                    chains: tuple[Chain, ...] = ()) -> NodeTable:
    """The node table of ``docs``, persisted and partitioned by document.

    So that joins on (document, x) add no further exchange, this sets
    ``spark.sql.requireAllClusterKeysForCoPartition`` to false in the session, and
    leaves it so: plans are made when results are read. Other queries of the session
    stay right; a join of theirs may reuse a coarser partitioning.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    nodes = shred(docs, key, html, columns, wanted, chains)
    return NodeTable(nodes.repartition(F.col("doc")).persist(), columns)


class XPath:
    """A compiled expression. It holds no state and can be evaluated over any number of tables."""

    def __init__(self, expression: str, profile: str = "compat"):
        self.expression, self.profile = expression, profile
        self.tree: Expr = parse_xpath(expression)
        trace("%s: parsed as %s", expression, self.tree)

    def needs(self, columns: Iterable[str], contents_only: bool, output: str, include_location: bool) -> tuple[set[str], Compiler]:
        """The node columns that the plan reads, and what its compiler found out about the nodes: found on an empty table."""
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        fields = [T.StructField("doc", T.LongType()), *NODE_FIELDS, CHAIN_FIELD]
        compiler = Compiler(spark.createDataFrame([], T.StructType(fields)), self.profile, chains=True)
        plan = self._plan(compiler, columns, contents_only, output, include_location)
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        # a leaf shows all columns of the table, the nodes above it those that are used
        text = "\n".join(line for line in text.splitlines() if "LogicalRDD" not in line)
        found = {c for c in (*NODE_COLUMNS, CHAIN_FIELD.name) if f"{c}#" in text}
        for line in compiler.notes:
            trace("%s: %s", self.expression, line)
        return found | {"pre", "parent", "kind"}, compiler

    def _plan(self, compiler: Compiler, columns: Iterable[str], contents_only: bool, output: str, include_location: bool) -> DataFrame:
        if is_nodes(self.tree):
            df, attributes = compiler.node_set(self.tree)
            return project(df, attributes, columns, contents_only, output, include_location)
        df, value = compiler.scalar(self.tree)
        out = {c: F.lit(None).cast(t) for c, t in _RESULT_TYPES.items()}
        out |= {"ord": F.lit(1), "value": value, "text_content": value}
        return df.select("doc", *[out[c].alias(c) for c in _chosen(columns, include_location)])

    def evaluate(self, docs: DataFrame | NodeTable, key: str = "doc_id", html: str = "html", columns: Iterable[str] = RESULT_COLUMNS,
                 contents_only: bool = False, output: str = "nodes", include_location: bool = True) -> DataFrame:
        """One row per match: the document's key (as ``key``) and ``columns``. ``ord`` is the match's place in its document, from 1."""
        if output not in FORMATS:
            raise ValueError(f"output must be one of {FORMATS}")
        columns = list(columns)
        if isinstance(docs, NodeTable):
            nodes = docs.df
        else:
            needs, found = self.needs(columns, contents_only, output, include_location)
            wanted, chains = None if found.wanted is None else frozenset(found.wanted), tuple(found.chains)
            trace("%s: reads columns %s of nodes %s, %d times", self.expression, sorted(needs), "all" if wanted is None else sorted(wanted), found.uses)
            if found.uses == 1:
                nodes = shred(docs, key, html, needs, wanted, chains)
            else:  # read more than once: parse once
                _IMPLICIT.append(shred_documents(docs, key, html, needs, wanted, chains))
                nodes = _IMPLICIT[-1].df
                while len(_IMPLICIT) > IMPLICIT_TABLES:
                    _IMPLICIT.pop(0).unpersist()
            missing = [f for f in (*NODE_FIELDS, CHAIN_FIELD) if f.name not in needs]
            nodes = nodes.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}) if missing else nodes
        chained = not isinstance(docs, NodeTable)
        result = self._plan(Compiler(nodes, self.profile, chains=chained), columns, contents_only, output, include_location)
        return result.withColumnRenamed("doc", key)

    def explain(self, docs: DataFrame | NodeTable, **options: object) -> str:
        """The syntax tree and the physical plan."""
        plan = self.evaluate(docs, **options)._jdf.queryExecution().toString()
        return f"{self.expression}\n{self.tree}\n{plan}"


_RESULT_TYPES = {
    "ord": "int", "value": "string", "node_name": "string", "node_type": "int", "attributes": "map<string,string>", "start_location": "int",
    "end_location": "int", "content_start": "int", "content_end": "int", "path": "string", "text_content": "string",
}


def _chosen(columns: Iterable[str], include_location: bool) -> list[str]:
    unknown = set(columns) - set(RESULT_COLUMNS)
    if unknown:
        raise ValueError(f"unknown result columns: {sorted(unknown)}")
    return [c for c in RESULT_COLUMNS if c in set(columns) and (include_location or c not in _LOCATIONS)]


def project(df: DataFrame, attributes: bool, columns: Iterable[str], contents_only: bool, output: str, include_location: bool) -> DataFrame:
    """Result rows of node rows. Contents-only locates an element's inner content, and its value is its text."""
    from pyspark.sql import Window

    text = F.coalesce("text", F.lit(""))
    whole = F.when(F.col("end") > F.col("start"), F.col("source")).otherwise(F.when(F.coalesce("node_value", F.lit("")) == "", text).otherwise(F.col("node_value")))
    value = text if contents_only else whole
    if output == "values":
        value = text if contents_only else F.when(text != "", text).otherwise(whole)
    elif output == "paths":
        value = F.col("path")
    order = ["pre", *(["a_idx"] if "a_idx" in df.columns else [])]
    out = {
        "ord": F.row_number().over(Window.partitionBy("doc").orderBy(*[F.asc_nulls_first(c) for c in order])),
        "value": value,
        "node_name": F.col("name"),
        "node_type": F.col("kind").cast("int"),
        "attributes": F.when(F.col("kind") == 1, F.col("attrs")),
        "start_location": F.col("content_start" if contents_only else "start"),
        "end_location": F.col("content_end" if contents_only else "end"),
        "content_start": F.col("content_start"),
        "content_end": F.col("content_end"),
        "path": F.col("path"),
        "text_content": text,
    }
    return df.select("doc", *[out[c].alias(c) for c in _chosen(columns, include_location)])


def compile_xpath(expression: str, profile: str = "compat") -> XPath:
    """Parse and check an expression; raises XPathSyntaxError if it is malformed."""
    return XPath(expression, profile)


def query(expression: str, docs: DataFrame | NodeTable, profile: str = "compat", **options: object) -> DataFrame:
    """Compile and evaluate in one call; options as in ``XPath.evaluate``."""
    return XPath(expression, profile).evaluate(docs, **options)


def query_many(expressions: Mapping[str, str], docs: DataFrame | NodeTable, key: str = "doc_id", html: str = "html", **options: object) -> DataFrame:
    """Several named expressions over one shredding, with a column ``query_name``."""
    table = docs if isinstance(docs, NodeTable) else shred_documents(docs, key, html)
    parts = [query(x, table, key=key, **options).withColumn("query_name", F.lit(name)) for name, x in expressions.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def errors(docs: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """Documents that cannot be queried, with the reason: blank ones, and any whose parse fails. It parses all documents once."""
    return parse_errors(docs, key, html)


def slice_source(html: str, start: str = "start_location", end: str = "end_location"):
    """The source between two byte offsets, as a column."""
    source = F.col(html).cast("binary")
    return F.make_valid_utf8(F.substring(source, F.col(start) + 1, F.col(end) - F.col(start)).cast("string"))


def to_json_documents(results: DataFrame, key: str = "doc_id", docs: DataFrame | None = None, html: str = "html") -> DataFrame:
    """One JSON object per document: results in order, their count, and an error or null.

    With ``docs``, documents without matches and those that cannot be queried have their object too.
    """
    fields = [c for c in results.columns if c != key]
    rows = F.collect_list(F.struct("ord", *[c for c in fields if c != "ord"]))
    grouped = results.groupBy(key).agg(F.array_sort(rows, lambda a, b: a["ord"] - b["ord"]).alias("results"))
    error = F.lit(None).cast("string")
    if docs is not None:
        every = docs.where(F.col(key).isNotNull()).select(key).distinct()
        grouped = every.join(grouped, key, "left").join(errors(docs, key, html).distinct(), key, "left")
        empty = F.array().cast(results.select(F.array(F.struct("ord", *[c for c in fields if c != "ord"])).alias("x")).schema["x"].dataType)
        grouped, error = grouped.withColumn("results", F.coalesce("results", empty)), F.col("error")
    body = F.struct("results", F.size("results").alias("count"), error.alias("error"))
    return grouped.select(key, F.to_json(body, {"ignoreNullFields": "false"}).alias("json"))


def register_table(spark: SparkSession, docs: DataFrame, name: str) -> None:
    """Make ``docs`` a view and ``html_nodes`` a table function, for ``FROM name d, LATERAL html_nodes(d.html) n``."""
    register_table_function(spark)
    docs.createOrReplaceTempView(name)
