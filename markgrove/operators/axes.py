"""The thirteen axes as joins on the pre-order encoding of the node table.

A step takes a context relation and yields candidates: node rows with ``c``, the
context node each was reached from, and ``o``, the origin, where the path is
evaluated for many origins at once. ``context=None`` stands for all nodes, which
makes child, descendant, self and attribute steps plain projections.

Every join has the document in its key, and all but following and preceding have
a second equality (the parent, or an exploded ancestor), so a table partitioned by
document is joined without moving it and no document is joined with itself whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.markup import ATTRIBUTE, COMMENT, ELEMENT, INSTRUCTION, TEXT

#: Axes whose positions count backwards: (in both profiles, in xpath1 alone).
_BACKWARDS = ({"ancestor", "preceding"}, {"ancestor-or-self", "preceding-sibling"})


@dataclass
class Candidates:
    """Rows of a step. ``distinct``: no node occurs twice for one origin. ``attributes``: rows are attributes (``a_idx``)."""

    df: DataFrame
    distinct: bool
    attributes: bool = False
    backwards: bool = False


def node_test(test: str, attributes: bool = False) -> Column:
    if attributes:
        return F.lit(True) if test in ("*", "node()") else F.col("name") == test
    if test == "*":
        return F.col("kind") == ELEMENT
    if test == "node()":
        return F.lit(True)
    if test == "text()":
        return F.col("kind") == TEXT
    if test == "comment()":
        return F.col("kind") == COMMENT
    if test.startswith("processing-instruction("):
        target = test[len("processing-instruction(") : -1]
        named = F.col("node_value").startswith(target) if target else F.lit(True)
        return (F.col("kind") == INSTRUCTION) & named
    return (F.col("kind") == ELEMENT) & (F.col("name") == test)


def _matched(nodes: DataFrame, context: DataFrame, on: Column, extra: list[str], order_free: bool) -> DataFrame:
    """``nodes`` joined to context columns; a semi join where nothing of the context is needed after."""
    if order_free and extra == ["c"]:
        return nodes.join(context, on, "left_semi").withColumn("c", F.lit(None).cast("int"))
    return nodes.join(context, on).select(*[F.col(c) for c in nodes.columns if c not in extra], *extra)


def take_axis(nodes: DataFrame, context: DataFrame | None, axis: str, test: str, origins: bool, positional: bool, profile: str) -> Candidates:
    """The candidates of ``axis::test``. With ``origins`` and no context, every node is its own origin."""
    backwards = axis in _BACKWARDS[0] or (profile == "xpath1" and axis in _BACKWARDS[1])
    tested = nodes.where(node_test(test))
    own = context is None

    if axis == "attribute":
        base = nodes if own else context
        if own and origins:
            base = base.withColumn("o", F.col("pre"))
        return Candidates(explode_attributes(base, test), True, attributes=True)
    if axis == "namespace":
        base = nodes if own else context
        empty = base.where(F.lit(False)).withColumn("c", F.col("pre"))
        return Candidates(empty.withColumn("o", F.col("pre")) if own and origins else empty, True)
    if axis == "self":
        base = tested if own else context.where(node_test(test))
        base = base.withColumn("c", F.col("pre"))
        return Candidates(base.withColumn("o", F.col("pre")) if own and origins else base, True)
    if own and axis in ("child", "descendant", "descendant-or-self"):
        if axis == "child":
            base = tested.where("parent IS NOT NULL").withColumn("c", F.col("parent"))
        elif not origins and not positional:  # below some node: all but the document, or all
            base = (tested.where("parent IS NOT NULL") if axis == "descendant" else tested).withColumn("c", F.col("parent"))
        else:
            ups = F.col("anc") if axis == "descendant" else F.array_append("anc", F.col("pre"))
            base = tested.withColumn("c", F.explode(ups))
        distinct = axis == "child" or origins or not positional
        return Candidates(base.withColumn("o", F.col("c")) if origins else base, distinct)

    if own:
        context = nodes.withColumn("o", F.col("pre")) if origins else nodes
    carried = ["o"] if origins else []
    extra = ["c", *carried]
    free = not positional and not origins
    d = F.col("doc").alias("_d")
    c = F.col("pre").alias("c")

    if axis == "child":
        ctx = context.select(d, c, *carried)
        return Candidates(_matched(tested, ctx, (F.col("doc") == F.col("_d")) & (F.col("parent") == F.col("c")), extra, free), True)
    if axis == "parent":
        ctx = context.select(d, c, F.col("parent").alias("_p"), *carried)
        return Candidates(_matched(tested, ctx, (F.col("doc") == F.col("_d")) & (F.col("pre") == F.col("_p")), extra, free), free)
    if axis in ("ancestor", "ancestor-or-self"):
        ups = F.col("anc") if axis == "ancestor" else F.array_append("anc", F.col("pre"))
        ctx = context.select(d, c, F.explode(ups).alias("_p"), *carried)
        on = (F.col("doc") == F.col("_d")) & (F.col("pre") == F.col("_p"))
        return Candidates(_matched(tested, ctx, on, extra, free), free, backwards=backwards)
    if axis in ("descendant", "descendant-or-self"):
        ups = F.col("anc") if axis == "descendant" else F.array_append("anc", F.col("pre"))
        ctx = context.select(d, c, *carried)
        below = tested.withColumn("_up", F.explode(ups))
        found = _matched(below, ctx, (F.col("doc") == F.col("_d")) & (F.col("_up") == F.col("c")), extra, free)
        return Candidates(found.drop("_up"), False)
    if axis in ("following-sibling", "preceding-sibling"):
        after = axis == "following-sibling"
        ctx = context.select(d, c, F.col("parent").alias("_p"), F.col("sib").alias("_s"), *carried)
        if free:  # some context sibling before it: the first one will do
            ctx = ctx.groupBy("_d", "_p").agg((F.min if after else F.max)("_s").alias("_s"), F.first("c").alias("c"))
        side = F.col("sib") > F.col("_s") if after else F.col("sib") < F.col("_s")
        on = (F.col("doc") == F.col("_d")) & (F.col("parent") == F.col("_p")) & side
        return Candidates(_matched(tested, ctx, on, extra, free), free, backwards=backwards)
    after = axis == "following"
    ctx = context.select(d, c, F.col("last" if after else "pre").alias("_e"), *carried)
    if free:  # after the context node that ends first
        ctx = ctx.groupBy("_d").agg((F.min if after else F.max)("_e").alias("_e"), F.first("c").alias("c"))
    side = F.col("pre") > F.col("_e") if after else F.col("last") < F.col("_e")
    found = _matched(tested.where("parent IS NOT NULL"), ctx, (F.col("doc") == F.col("_d")) & side, extra, free)
    return Candidates(found, free, backwards=backwards)


def explode_attributes(elements: DataFrame, test: str) -> DataFrame:
    """Attribute rows of element rows: the attribute's name and value in ``name`` and ``text``, and no offsets of its own."""
    elements = elements.where(F.col("kind") == ELEMENT)
    if test not in ("*", "node()"):
        elements = elements.where(F.col("attrs")[test].isNotNull())
        rows = elements.withColumns({"a_idx": F.array_position("attr_order", test).cast("int") - 1, "_a": F.lit(test)})
    else:
        kept = [F.col(x) for x in elements.columns]
        rows = elements.select(*kept, F.posexplode("attr_order").alias("a_idx", "_a"))
    zero = F.lit(0)
    return rows.withColumns({
        "c": F.col("pre"), "name": F.col("_a"), "text": F.col("attrs")[F.col("_a")], "node_value": F.lit(""), "kind": F.lit(ATTRIBUTE).cast("byte"),
        "path": F.concat("path", F.lit("/"), F.col("_a")), "start": zero, "end": zero, "content_start": zero, "content_end": zero, "source": F.lit(""),
    }).drop("_a")
