"""From XPath trees to DataFrame plans: axes are joins, predicates filters and semi joins, positions windows, counts aggregates.

Rewrites, all on the tree: a leading ``//x`` is a filter on the node table with the
parent as context; ``a//x`` without positions is one descendant join; existence in
a conjunction is a semi join and its negation an anti join; counts and first
values of a sub-path are one grouped sub-plan joined by origin; an attribute of
the candidate is a map look-up; steps that cannot repeat a node are not followed by
a distinct. Positions among a parent's children of one name are columns of the node
table, so ``x[n]``, ``x[last()]`` and ``x[position() <= n]`` are filters, and so are
counts and existence of siblings of the candidate's own name. Existence on the
sibling, following and preceding axes is a minimum or maximum a parent or document,
counts on them are a running sum, and the n-th sibling is an equi join on ranks: no
step pairs all siblings with each other.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.values import Value
from ..operators.axes import node_test, take_axis
from .ast import ANYWHERE, Binary, Call, Expr, Filter, Literal, Negate, Number, Path, Step, Union, walk

PROFILES = ("compat", "xpath1")
_COMPARISONS = ("=", "!=", "<", ">", "<=", ">=")
_SIBLINGS = ("following-sibling", "preceding-sibling")
_BESIDE = (*_SIBLINGS, "following", "preceding")
_NUMERIC_CALLS = frozenset(["count", "last", "position", "number", "string-length"])


def is_numeric(e: Expr) -> bool:
    return isinstance(e, (Number, Negate)) or (isinstance(e, Binary) and e.op in ("+", "-", "*", "div", "mod")) or (isinstance(e, Call) and e.name in _NUMERIC_CALLS)


def is_positional(e: Expr) -> bool:
    """A predicate that needs the candidate's position or the number of candidates."""
    return is_numeric(e) or any(isinstance(x, Call) and x.name in ("position", "last") for x in walk(e, into_predicates=False))


def is_nodes(e: Expr) -> bool:
    return isinstance(e, (Path, Filter, Union))


class Compiler:
    """Builds the plan of one expression over a node table; ``uses`` counts how often the table is read."""

    def __init__(self, nodes: DataFrame, profile: str = "compat", chains: bool = False):
        if profile not in PROFILES:
            raise ValueError(f"profile must be one of {PROFILES}")
        self._nodes, self.profile, self.uses, self._names = nodes, profile, 0, count()
        #: Node tests that cover all rows the plan reads; None once it reads any node.
        self.wanted: set[str] | None = set()
        #: Paths that the parser follows, if the table is shredded for this query: (may skip levels, test) a step.
        self.chains: list[tuple[tuple[bool, str], ...]] = []
        self._chained = chains
        #: The rewrites that were applied, for the trace.
        self.notes: list[str] = []
        #: The node test of the candidates whose predicates are being compiled, where it is known.
        self._own: str | None = None

    def scan(self, test: str) -> DataFrame:
        """The node table, of which only nodes that ``test`` matches will be read (``@x``: elements with that attribute)."""
        self.uses += 1
        if test == "node()":
            self.wanted = None
        elif self.wanted is not None:
            self.wanted.add("processing-instruction()" if test.startswith("processing-instruction(") else test)
        return self._nodes

    @staticmethod
    def _read_by(step: Step, anywhere: bool) -> str:
        """What a step reads of the node table: its test, or any node as a context."""
        if step.axis == "attribute":
            return "*" if step.test in ("*", "node()") else f"@{step.test}"
        if anywhere and step.axis not in ("child", "descendant", "descendant-or-self", "self"):
            return "node()"
        return step.test

    def _narrowed(self, step: Step) -> str:
        """What a step from all nodes reads: with ``x[@a='v']`` first, of elements x only those."""
        test = self._read_by(step, True)
        if step.axis != "child" or not self._counted(test) or test.endswith(")") or not step.predicates:
            return test
        e = step.predicates[0]
        while isinstance(e, Binary) and e.op == "and":
            e = e.left
        if isinstance(e, Binary) and e.op == "=" and isinstance(e.left, Path) and isinstance(e.right, Literal):
            steps, value = e.left.steps, e.right.value
            named = e.left.start == "here" and len(steps) == 1 and steps[0].axis == "attribute" and steps[0].test not in ("*", "node()") and not steps[0].predicates
            if named and value and not V.spells_number(value):  # numbers compare by value, and "" also equals nothing
                self.notes.append(f"@{steps[0].test}='{value}' goes to the parser")
                return f"{test}@{steps[0].test}={value}"
        return test

    def fresh(self, stem: str) -> str:
        return f"_{stem}{next(self._names)}"

    # -- node-sets

    def node_set(self, e: Expr, origins: DataFrame | None = None, with_origin: bool = False) -> tuple[DataFrame, bool]:
        """Distinct rows of a node-set (with ``o`` if ``with_origin``), and whether they are attributes."""
        if isinstance(e, Path):
            return self.path(e, origins, with_origin)
        if isinstance(e, Union):
            parts = [self.node_set(p, origins, with_origin) for p in e.parts]
            attributes = [a for _, a in parts]
            if any(attributes):
                parts = [(df if a else df.withColumn("a_idx", F.lit(None).cast("int")), a) for df, a in parts]
            whole = parts[0][0]
            for df, _ in parts[1:]:
                whole = whole.unionByName(df.select(*whole.columns))
            key = ["doc", "pre", *(["a_idx"] if any(attributes) else []), *(["o"] if with_origin else [])]
            return whole.dropDuplicates(key), any(attributes)
        if isinstance(e, Filter):
            df, attributes = self.node_set(e.operand, origins, with_origin)
            whole, outer, self._own = [*(["o"] if with_origin else [])], self._own, None
            for p in e.predicates:
                df = self.predicate(df, p, attributes, ["doc", *whole], backwards=False)
            self._own = outer
            return df, attributes
        raise TypeError(f"{type(e).__name__} is not a node-set")

    def path(self, path: Path, origins: DataFrame | None, with_origin: bool) -> tuple[DataFrame, bool]:
        steps, attributes, before = list(path.steps), False, self._own if path.start == "here" else None
        carry = with_origin and path.start != "root"
        chained = None if path.start not in ("root", "here") or (path.start == "here" and (origins is not None or with_origin)) else self._chain(path)
        if chained is not None:
            df, steps, before = chained
        elif path.start == "root":
            if steps and steps[0] == ANYWHERE:
                steps, df = steps[1:], None
                if not steps:
                    return self.scan("node()").withColumn("c", F.col("pre")), False
            else:
                df = self.scan("#document").where("parent IS NULL").withColumn("c", F.col("pre"))
        elif path.start == "here":
            df = origins
        else:
            df, attributes = self.node_set(path.start, origins, with_origin)
        while steps:
            step = steps.pop(0)
            if step == ANYWHERE and steps and df is not None and steps[0].axis == "child" and not self._counts(steps[0]):
                step = Step("descendant", steps[0].test, steps.pop(0).predicates, by_parent=True)
            beside = None if attributes else self._sibling_step(df, step, carry, before)
            df, attributes = (beside, False) if beside is not None else self.step(df, step, carry, attributes)
            before = None if attributes else step.test
        return df, attributes

    def _chain(self, path: Path) -> tuple[DataFrame, list[Step], str] | None:
        """The nodes at the end of the path's leading child and descendant steps without predicates (but the last), found by the parser."""
        skips, chain, used, last = path.start == "here", [], 0, None
        for i, s in enumerate(path.steps):
            if s == ANYWHERE:
                skips = True
                continue
            if s.axis != "child" or s.test == "node()" or (s.test.endswith(")") and s.test not in ("text()", "comment()")):
                break
            chain.append((skips, s.test))
            skips, used, last = False, i + 1, s
            if s.predicates or s.test.endswith(")"):
                break
        # of //x alone a filter on names is all
        if not self._chained or not chain or (len(chain) == 1 and chain[0][0]) or len(self.chains) > 30:
            return None
        number = len(self.chains)
        self.chains.append(tuple(chain))
        self.notes.append(f"steps 1 to {used} are followed by the parser")
        self.uses += 1
        if self.wanted is not None:
            self.wanted.add(f"chain {number}")
        df = self._nodes.where(F.col("chains").bitwiseAND(F.lit(1 << number)) != 0).where(node_test(last.test)).withColumn("c", F.col("parent"))
        return self.predicates(df, last, False, ["doc", "c"], False), list(path.steps[used:]), last.test

    def step(self, context: DataFrame | None, step: Step, carry: bool, attributes: bool) -> tuple[DataFrame, bool]:
        positional = self._counts(step)
        if attributes:
            return self._step_from_attribute(context, step, carry)
        if context is not None and step.axis in ("attribute", "self", "namespace"):
            nodes = self._nodes  # the context's own rows answer
        else:
            nodes = self.scan(self._narrowed(step) if context is None else self._read_by(step, False))
        found = take_axis(nodes, context, step.axis, step.test, carry, positional, self.profile)
        df = found.df
        group = ["doc", "c", *(["o"] if carry else [])]
        df = self.predicates(df, step, found.attributes, group, found.backwards)
        if not found.distinct:
            # keys first, then the rows again: no wide column goes through the aggregate
            key = ["doc", "pre", *(["o"] if carry else [])]
            keys = df.select(*key).distinct()
            wide = self.scan(step.test)
            on = (F.col("doc") == F.col("_kd")) & (F.col("pre") == F.col("_kp"))
            keys = keys.select(F.col("doc").alias("_kd"), F.col("pre").alias("_kp"), *(["o"] if carry else []))
            df = (wide.join(keys, on).drop("_kd", "_kp") if carry else wide.join(keys, on, "left_semi")).withColumn("c", F.col("pre"))
        return df, found.attributes

    def _step_from_attribute(self, context: DataFrame, step: Step, carry: bool) -> tuple[DataFrame, bool]:
        """From an attribute only itself, its element and the element's ancestors can be reached."""
        if step.axis in ("self", "descendant-or-self"):
            df = context.where(node_test(step.test, attributes=True))
            return self.predicates(df, step, True, ["doc", "pre", "a_idx", *(["o"] if carry else [])], False), True
        up = {"parent": "self", "ancestor": "ancestor-or-self"}.get(step.axis)
        keys = context.select(F.col("doc").alias("_kd"), F.col("pre").alias("_kp"), *(["o"] if carry else [])).distinct()
        on = (F.col("doc") == F.col("_kd")) & (F.col("pre") == F.col("_kp"))
        elements = self.scan("*").join(keys, on).drop("_kd", "_kp")
        if up is None:
            elements, up = elements.where(F.lit(False)), "self"
        return self.step(elements, Step(up, step.test, step.predicates), carry, False)

    # -- steps along siblings

    @staticmethod
    def _counted(test: str) -> bool:
        """Whether ``name_pos`` and ``name_cnt`` count the nodes that ``test`` matches among their siblings."""
        return test not in ("*", "node()") and not (test.startswith("processing-instruction(") and test != "processing-instruction()")

    def _counts(self, step: Step) -> bool:
        """Whether a predicate counts candidates in a way that the node table's positions do not answer."""
        known = self._counted(step.test) and (step.axis == "child" or step.by_parent)
        return any(map(is_positional, step.predicates[1 if known else 0 :]))

    def _matching(self, step: Step) -> DataFrame:
        """All nodes that a step's test and predicates, none of them positional, match."""
        return self.predicates(self.scan(step.test).where(node_test(step.test)).where("parent IS NOT NULL"), step, False, [], False)

    def _running(self, df: DataFrame, marks: DataFrame, group: list[str], own: str, their: str, after: bool) -> DataFrame:
        """doc, pre and ``n`` for the distinct nodes of ``df``: the number of ``marks`` in their group after (before) them."""
        at = self.fresh("at")
        points = df.select(*group, F.col(own).alias(at), F.col("pre"), F.lit(0).alias("_m")).dropDuplicates(["doc", "pre"])
        both = points.unionByName(marks.select(*group, F.col(their).alias(at), F.lit(None).cast("int").alias("pre"), F.lit(1).alias("_m")))
        frame = Window.partitionBy(*group).orderBy(at)
        frame = frame.rangeBetween(1, Window.unboundedFollowing) if after else frame.rangeBetween(Window.unboundedPreceding, -1)
        counted = both.withColumn("n", F.coalesce(F.sum("_m").over(frame), F.lit(0)).cast("int")).where(F.col("pre").isNotNull())
        return counted.select("doc", "pre", "n")

    def _sibling_step(self, context: DataFrame | None, step: Step, carry: bool, before: str | None) -> DataFrame | None:
        """``following-sibling::x[n]`` and its like as an equi join on ranks; None for steps of other forms."""
        plain = [p for p in step.predicates if not is_positional(p)]
        rest = list(step.predicates[len(plain) :])
        if context is None or step.axis not in _SIBLINGS or list(step.predicates[: len(plain)]) != plain or not rest or not self._counted(step.test):
            return None
        place, rest = rest[0], rest[1:]
        if not (place == Call("last") or (isinstance(place, Number) and place.value == int(place.value) and place.value >= 1)) or any(map(is_positional, rest)):
            return None
        after = step.axis == "following-sibling"
        backwards = not after and self.profile == "xpath1"
        columns = self._nodes.columns
        matched = self._matching(Step(step.axis, step.test, tuple(plain)))
        rows = Window.partitionBy("doc", "parent")
        if plain:
            matched = matched.withColumn("_r", F.row_number().over(rows.orderBy("sib")))
            size = F.count("*").over(rows)
        else:
            matched, size = matched.withColumn("_r", F.col("name_pos")), F.col("name_cnt")
        keys = [F.col("doc").alias("_d"), F.col("parent").alias("_p"), F.col("pre").alias("c"), *(["o"] if carry else [])]
        if not plain and before == step.test:  # of those up to the context node itself
            upto = context.select(*keys, (F.col("name_pos") if after else F.col("name_pos") - 1).alias("_b"))
        else:
            marks = self._matching(Step(step.axis, step.test, tuple(plain)))
            counts = self._running(context, marks, ["doc", "parent"], "sib", "sib", False)
            if after:  # the context node may match itself
                itself = marks.select(F.col("doc").alias("_id"), F.col("pre").alias("_ip"))
                counts = counts.join(itself, (F.col("doc") == F.col("_id")) & (F.col("pre") == F.col("_ip")), "left")
                counts = counts.select("doc", "pre", (F.col("n") + F.col("_ip").isNotNull().cast("int")).alias("n"))
            counts = counts.select(F.col("doc").alias("_cd"), F.col("pre").alias("_cp"), F.col("n").alias("_b"))
            upto = context.join(counts, (F.col("doc") == F.col("_cd")) & (F.col("pre") == F.col("_cp"))).select(*keys, "_b")
        if after:
            at = F.col("_b") + int(place.value) if isinstance(place, Number) else None
        elif place == Call("last"):
            at = F.lit(1) if backwards else F.col("_b")
        else:
            at = F.col("_b") - int(place.value) + 1 if backwards else F.lit(int(place.value))
        self.notes.append(f"{step.axis}::{step.test} by rank")
        if at is None:  # the last one of all, if it is after the context node
            matched = matched.withColumn("_size", size).where("_r = _size")
            on = F.col("_r") > F.col("_b")
        else:
            upto = upto.withColumn("_at", at)
            upto = upto if after else upto.where("_at BETWEEN 1 AND _b")
            on = F.col("_r") == F.col("_at")
        on = (F.col("doc") == F.col("_d")) & (F.col("parent") == F.col("_p")) & on
        key = ["doc", "pre", *(["o"] if carry else [])]
        found = matched.join(upto, on).select(*columns, "c", *(["o"] if carry else [])).dropDuplicates(key) if carry else matched.join(upto, on, "left_semi").select(*columns, F.col("pre").alias("c"))
        return self.predicates(found, Step(step.axis, step.test, tuple(rest)), False, [], False)

    def _beside(self, e: Expr) -> Step | None:
        """The only step of a path along siblings, or to all that follows or precedes, without positions."""
        if isinstance(e, Path) and e.start == "here" and len(e.steps) == 1 and e.steps[0].axis in _BESIDE and not any(map(is_positional, e.steps[0].predicates)):
            return e.steps[0]
        return None

    @staticmethod
    def _sides(axis: str) -> tuple[list[str], str, str, bool]:
        """What candidate and found node share, the place of the first, of the second, and whether the second comes after."""
        if axis in _SIBLINGS:
            return ["doc", "parent"], "sib", "sib", axis == "following-sibling"
        return ["doc"], *(("last", "pre", True) if axis == "following" else ("pre", "last", False))

    def _exists_beside(self, df: DataFrame, step: Step) -> tuple[DataFrame, Column]:
        """Whether any node is there: by the extreme place of such nodes under the parent, or in the document."""
        self.notes.append(f"existence on {step.axis} by the extreme place")
        group, own, their, after = self._sides(step.axis)
        names = [self.fresh("g") for _ in group]
        edge = self.fresh("e")
        edges = self._matching(step).groupBy(*group).agg((F.max if after else F.min)(their).alias(edge))
        edges = edges.select(*[F.col(g).alias(n) for g, n in zip(group, names, strict=True)], edge)
        on = F.lit(True)
        for g, n in zip(group, names, strict=True):
            on = on & (F.col(g) == F.col(n))
        df = df.join(edges, on, "left").drop(*names)
        side = F.col(edge) > F.col(own) if after else F.col(edge) < F.col(own)
        return df, F.coalesce(side, F.lit(False))

    # -- predicates

    def predicates(self, df: DataFrame, step: Step, attributes: bool, group: list[str], backwards: bool) -> DataFrame:
        """``df`` where all predicates of ``step`` hold, one after the other."""
        outer, self._own = self._own, None if attributes else step.test
        known = None
        if (step.axis == "child" or step.by_parent) and not attributes and self._counted(step.test):
            known = F.col("name_pos"), F.col("name_cnt")
        for p in step.predicates:
            df = self.predicate(df, p, attributes, group, backwards, known)
            known = None  # the next one counts what this one left
        self._own = outer
        return df

    def predicate(self, df: DataFrame, e: Expr, attributes: bool, group: list[str], backwards: bool, known: tuple[Column, Column] | None = None) -> DataFrame:
        """``df`` where ``e`` holds; a number must equal the position among the rows of ``group``.

        ``known`` are position and number of rows, where the node table has them.
        """
        if not is_positional(e):
            return self.where(df, e, attributes)
        columns = df.columns
        if known:
            self.notes.append("position from the node table")
            position, size = known
            if isinstance(e, Number):
                return df.where(position == F.lit(e.value)) if e.value == int(e.value) else df.where(F.lit(False))
            if e == Call("last"):
                return df.where(position == size)
            df = df.withColumns({"_pos": position, "_size": size})
            if is_numeric(e):
                df, v = self.value(df, e, attributes)
                return df.where(F.col("_pos").cast("double") == V.as_number(v)).select(*columns)
            return self.where(df, e, attributes).select(*columns)
        order = [F.col("pre").desc() if backwards else F.col("pre"), *(["a_idx"] if attributes else [])]
        rows = Window.partitionBy(*group)
        if isinstance(e, Number):  # a rank limit that the planner pushes below the shuffle
            if e.value != int(e.value) or e.value < 1:
                return df.where(F.lit(False))
            return df.withColumn("_pos", F.row_number().over(rows.orderBy(*order))).where(F.col("_pos") == int(e.value)).select(*columns)
        if e == Call("last"):
            flipped = [F.col("pre") if backwards else F.col("pre").desc(), *([F.col("a_idx").desc()] if attributes else [])]
            return df.withColumn("_pos", F.row_number().over(rows.orderBy(*flipped))).where("_pos = 1").select(*columns)
        uses = {x.name for x in walk(e, into_predicates=False) if isinstance(x, Call)}
        if "position" in uses or is_numeric(e):
            df = df.withColumn("_pos", F.row_number().over(rows.orderBy(*order)))
        if "last" in uses:
            df = df.withColumn("_size", F.count("*").over(rows))
        if is_numeric(e):
            df, v = self.value(df, e, attributes)
            df = df.where(F.col("_pos").cast("double") == V.as_number(v))
        else:
            df = self.where(df, e, attributes)
        return df.select(*columns)

    def where(self, df: DataFrame, e: Expr, attributes: bool = False) -> DataFrame:
        """Conjunctions one by one; existence as a semi join, its negation as an anti join."""
        columns = df.columns
        e = self._as_spec(e)
        if isinstance(e, Binary) and e.op == "and":
            return self.where(self.where(df, e.left, attributes), e.right, attributes)
        negated = isinstance(e, Call) and e.name == "not"
        inner = self._as_spec(e.args[0]) if negated else e
        if is_nodes(inner) and self._local(inner, attributes) is None and not attributes and self._beside(inner) is None:
            found = self.related(df, inner)
            right, on = self._keys(found, inner)
            return df.join(right, on, "left_anti" if negated else "left_semi")
        df, condition = self.boolean(df, e, attributes)
        return df.where(condition).select(*columns)

    def boolean(self, df: DataFrame, e: Expr, attributes: bool) -> tuple[DataFrame, Column]:
        e = self._as_spec(e)
        if isinstance(e, Binary) and e.op in ("and", "or"):
            df, left = self.boolean(df, e.left, attributes)
            df, right = self.boolean(df, e.right, attributes)
            return df, (left & right) if e.op == "and" else (left | right)
        if is_nodes(e):
            df, v = self.nodes_value(df, e, attributes, "exists")
            return df, v.exists
        if isinstance(e, Call) and e.name == "text":
            return df, F.col("text") != ""
        if self.profile == "xpath1" and isinstance(e, Binary) and e.op in _COMPARISONS and is_nodes(e.left) and is_nodes(e.right) and not attributes:
            if self._local(e.left, False) is None or self._local(e.right, False) is None:
                return self._compare_sets(df, e)
        df, v = self.value(df, e, attributes)
        return df, F.coalesce(V.as_boolean(v), F.lit(False))

    def _compare_sets(self, df: DataFrame, e: Binary) -> tuple[DataFrame, Column]:
        """Whether any node on the left compares so with any on the right: a join of equal strings, or the extremes of both."""
        sides = []
        for operand, mark in ((e.left, "l"), (e.right, "r")):
            found = self.related(df, operand)
            keys = [k for k in ("doc", "o") if k in found.columns]
            text = F.coalesce("text", F.lit(""))
            if e.op == "=":
                sides.append((found.select(*[F.col(k).alias(f"_{mark}{k}") for k in keys], text.alias("_t" + mark)).distinct(), keys))
            else:
                v = text if e.op == "!=" else V.parse_number(text)
                known = v.isNotNull() & (F.lit(True) if e.op == "!=" else ~F.isnan(v))
                grouped = found.where(known).groupBy(*keys).agg(F.min(v).alias("_min" + mark), F.max(v).alias("_max" + mark))
                sides.append((grouped.select(*[F.col(k).alias(f"_{mark}{k}") for k in keys], "_min" + mark, "_max" + mark), keys))
        (left, lk), (right, rk) = sides
        on = F.col("_ldoc") == F.col("_rdoc")
        if "o" in lk and "o" in rk:
            on = on & (F.col("_lo") == F.col("_ro"))
        holds = {
            "=": lambda: F.col("_tl") == F.col("_tr"), "!=": lambda: (F.col("_minl") != F.col("_maxr")) | (F.col("_maxl") != F.col("_minr")),
            "<": lambda: F.col("_minl") < F.col("_maxr"), "<=": lambda: F.col("_minl") <= F.col("_maxr"),
            ">": lambda: F.col("_maxl") > F.col("_minr"), ">=": lambda: F.col("_maxl") >= F.col("_minr"),
        }[e.op]()
        flag, d, o = self.fresh("s"), self.fresh("d"), self.fresh("o")
        origin = "_lo" if "o" in lk else "_ro" if "o" in rk else None
        true = left.join(right, on & holds).select(F.col("_ldoc").alias(d), *([F.col(origin).alias(o)] if origin else [])).distinct().withColumn(flag, F.lit(True))
        at = (F.col("doc") == F.col(d)) & (F.col("pre") == F.col(o)) if origin else F.col("doc") == F.col(d)
        df = df.join(true, at, "left").drop(d, *([o] if origin else []))
        return df, F.coalesce(F.col(flag), F.lit(False))

    # -- values

    def _as_spec(self, e: Expr) -> Expr:
        """In the xpath1 profile: bare text() and node() are child steps, and comparing a node-set with a constant asks for any node."""
        if self.profile != "xpath1":
            return e
        if e in (Call("text"), Call("node")):
            return Path("here", (Step("child", f"{e.name}()"),))
        if isinstance(e, Binary) and e.op in _COMPARISONS:
            left, right, op = self._as_spec(e.left), self._as_spec(e.right), e.op
            if isinstance(left, (Literal, Number)) and isinstance(right, Path):
                left, right, op = right, left, {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op)
            if isinstance(left, Path) and left.steps and left.steps[-1].axis != "self" and isinstance(right, (Literal, Number)):
                *steps, last = left.steps
                test = Binary(op, Path("here", (Step("self", "node()"),)), right)
                return Path(left.start, (*steps, Step(last.axis, last.test, (*last.predicates, test))))
        return e

    def value(self, df: DataFrame, e: Expr, attributes: bool) -> tuple[DataFrame, Value]:
        spec = self._as_spec(e)
        if spec is not e:
            if isinstance(e, Binary):
                df, condition = self.boolean(df, spec, attributes)
                return df, Value("bool", condition)
            e = spec
        if isinstance(e, Literal):
            return df, Value("str", F.lit(e.value))
        if isinstance(e, Number):
            return df, Value("num", F.lit(e.value))
        if isinstance(e, Negate):
            df, v = self.value(df, e.operand, attributes)
            return df, Value("num", -F.coalesce(V.as_number(v), F.lit(0.0)))
        if isinstance(e, Binary):
            if e.op in ("and", "or"):
                df, condition = self.boolean(df, e, attributes)
                return df, Value("bool", condition)
            df, left = self.value(df, e.left, attributes)
            df, right = self.value(df, e.right, attributes)
            if e.op in _COMPARISONS:
                return df, Value("bool", V.compare(e.op, left, right))
            return df, Value("num", V.arithmetic(e.op, left, right))
        if isinstance(e, Call):
            return self.call(df, e, attributes)
        return self.nodes_value(df, e, attributes, "first")

    def call(self, df: DataFrame, e: Call, attributes: bool) -> tuple[DataFrame, Value]:
        name, text = e.name, F.coalesce(F.col("text"), F.lit(""))
        if name == "position":
            return df, Value("num", F.col("_pos").cast("double"))
        if name == "last":
            return df, Value("num", F.col("_size").cast("double"))
        if name == "text":
            return df, Value("str", text)
        if name == "node":
            return df, Value("bool", F.lit(False) if attributes else F.col("last") > F.col("pre"))
        if name in ("true", "false"):
            return df, Value("bool", F.lit(name == "true"))
        if name in ("not", "boolean"):
            df, condition = self.boolean(df, e.args[0], attributes)
            return df, Value("bool", ~condition if name == "not" else condition)
        if name == "count":
            return self.count(df, e.args[0], attributes)
        if name in ("name", "local-name", "namespace-uri"):
            if e.args:
                df, v = self.nodes_value(df, e.args[0], attributes, "name")
                tag = v.column
            else:
                tag = F.when(F.col("name").startswith("#"), "").otherwise(F.col("name"))
            if name == "namespace-uri":
                tag = F.lit("")
            return df, Value("str", F.substring_index(tag, ":", -1) if name == "local-name" else tag)
        args = []
        for arg in e.args:
            df, v = self.value(df, arg, attributes)
            args.append(v)
        if not args and name in ("string", "number", "string-length", "normalize-space"):
            args = [Value("str", text)]
        if name == "number":
            return df, Value("num", F.coalesce(V.as_number(args[0]), F.lit(float("nan"))))
        strings = [V.as_string(v) for v in args]
        if name == "string":
            return df, Value("str", strings[0])
        if name == "concat":
            return df, Value("str", V.concat(strings))
        if name in ("contains", "starts-with"):
            return df, Value("bool", (F.contains if name == "contains" else F.startswith)(*strings))
        if name == "substring-before":
            return df, Value("str", V.substring_before(*strings))
        if name == "substring-after":
            return df, Value("str", V.substring_after(*strings))
        if name == "string-length":
            return df, Value("num", V.string_length(strings[0], self.profile))
        if name == "normalize-space":
            return df, Value("str", V.normalize_space(strings[0]))
        if name == "substring":
            start, *length = (F.coalesce(V.as_number(v), F.lit(0.0)) for v in args[1:])
            return df, Value("str", V.substring(strings[0], start, length[0] if length else None, self.profile))
        raise NotImplementedError(name)

    def count(self, df: DataFrame, e: Expr, attributes: bool) -> tuple[DataFrame, Value]:
        """The number of nodes; of the forms text() and node() that of such children, of other values 1 if true."""
        if isinstance(e, Call) and e.name in ("text", "node"):
            e = Path("here", (Step("child", f"{e.name}()"),))
        if is_nodes(e):
            df, v = self.nodes_value(df, e, attributes, "count")
            return df, Value("num", v.column.cast("double"))
        df, condition = self.boolean(df, e, attributes)
        return df, Value("num", condition.cast("double"))

    # -- sub-paths of a candidate

    def _local(self, e: Expr, attributes: bool) -> dict[str, Column] | None:
        """exists, count, first and name of a path that the candidate's own row answers; None for others."""
        if not (isinstance(e, Path) and e.start == "here" and len(e.steps) == 1 and not e.steps[0].predicates):
            return None
        step = e.steps[0]
        if step.axis in _SIBLINGS and not attributes and step.test == self._own and self._counted(step.test):
            n = F.col("name_cnt") - F.col("name_pos") if step.axis == "following-sibling" else F.col("name_pos") - 1
            if step.test[-1] != ")":
                return {"exists": n > 0, "count": n, "name": F.when(n > 0, step.test).otherwise("")}
            return {"exists": n > 0, "count": n}
        if step.axis == "self":
            test = node_test(step.test, attributes)
            return {"exists": test, "count": test.cast("int"), "first": F.when(test, F.col("text")).otherwise(""), "name": F.when(test, F.col("name")).otherwise("")}
        if step.axis != "attribute" or attributes:
            return None
        if step.test in ("*", "node()"):
            size = F.coalesce(F.size("attr_order"), F.lit(0))
            size = F.greatest(size, F.lit(0))
            tag = F.get("attr_order", F.lit(0))
            return {"exists": size > 0, "count": size, "first": F.coalesce(F.col("attrs")[tag], F.lit("")), "name": F.coalesce(tag, F.lit(""))}
        got = F.col("attrs")[step.test]
        return {"exists": got.isNotNull(), "count": got.isNotNull().cast("int"), "first": F.coalesce(got, F.lit("")), "name": F.when(got.isNotNull(), step.test).otherwise("")}

    def related(self, df: DataFrame, e: Expr) -> DataFrame:
        """The nodes of ``e`` for each candidate as origin ``o``; for a path from the root, of the document."""
        needs_rows = any(isinstance(x, Path) and x.start == "here" and x.steps[0].axis.split("-")[0] in ("following", "preceding", "ancestor") for x in walk(e, False))
        origins = None
        if needs_rows:
            origins = df.select("doc", "pre", "parent", "sib", "name_pos", "name_cnt", "last", "anc", "depth", "kind", "name", "attrs", "attr_order", "text", F.col("pre").alias("o")).dropDuplicates(["doc", "pre"])
        return self.node_set(e, origins, with_origin=True)[0]

    def _keys(self, found: DataFrame, e: Expr, *more: Column) -> tuple[DataFrame, Column]:
        """``found`` by renamed document and origin (document alone for an absolute path), and the join condition."""
        d, o = self.fresh("d"), self.fresh("o")
        if "o" not in found.columns:
            return found.select(F.col("doc").alias(d), *more), F.col("doc") == F.col(d)
        return found.select(F.col("doc").alias(d), F.col("o").alias(o), *more), (F.col("doc") == F.col(d)) & (F.col("pre") == F.col(o))

    def nodes_value(self, df: DataFrame, e: Expr, attributes: bool, want: str) -> tuple[DataFrame, Value]:
        """``want`` of a node-set as columns of ``df``: exists, count, first (its string) or name (of the first)."""
        if not is_nodes(e):
            raise TypeError("a node-set is needed here")
        local = self._local(e, attributes)
        if local is None and attributes:
            local = {"exists": F.lit(False), "count": F.lit(0), "first": F.lit(""), "name": F.lit("")}
        if local is not None and (want == "exists" or want in local):
            return df, Value("nodes", local.get("first", F.lit("")) if want == "exists" else local[want], local["exists"])
        beside = self._beside(e)
        if beside is not None and want == "exists":
            df, there = self._exists_beside(df, beside)
            return df, Value("nodes", F.lit(""), there)
        if beside is not None and want == "count":
            group, own, their, after = self._sides(beside.axis)
            n, d, p = self.fresh("n"), self.fresh("d"), self.fresh("p")
            counts = self._running(df, self._matching(beside), group, own, their, after).select(F.col("doc").alias(d), F.col("pre").alias(p), F.col("n").alias(n))
            df = df.join(counts, (F.col("doc") == F.col(d)) & (F.col("pre") == F.col(p)), "left").drop(d, p)
            return df, Value("nodes", F.coalesce(F.col(n), F.lit(0)), F.coalesce(F.col(n), F.lit(0)) > 0)
        if beside is not None and beside.axis in _SIBLINGS and self._counted(beside.test):  # the first in document order
            first = Call("last") if beside.axis == "preceding-sibling" and self.profile == "xpath1" else Number(1.0)
            e = Path("here", (Step(beside.axis, beside.test, (*beside.predicates, first)),))
        found = self.related(df, e)
        key = ["doc", *(["o"] if "o" in found.columns else [])]
        place = F.struct("pre", F.col("a_idx") if "a_idx" in found.columns else F.lit(0).alias("a_idx"))
        out = self.fresh("v")
        if want == "exists":
            grouped = found.select(*key).distinct().withColumn(out, F.lit(1))
        elif want == "count":
            grouped = found.groupBy(*key).agg(F.count("*").alias(out))
        else:
            grouped = found.groupBy(*key).agg(F.min_by("text" if want == "first" else "name", place).alias(out))
        right, on = self._keys(grouped, e, F.col(out))
        df = df.join(right, on, "left").drop(*[c for c in right.columns if c != out])
        exists = F.col(out).isNotNull()
        empty = F.lit(0) if want == "count" else F.lit("")
        return df, Value("nodes", F.coalesce(F.col(out), empty) if want != "exists" else F.lit(""), exists)

    def scalar(self, e: Expr) -> tuple[DataFrame, Column]:
        """One row per document and the string of the value of ``e``."""
        documents = self.scan("#document").where("parent IS NULL").withColumn("c", F.col("pre"))
        df, v = self.value(documents, e, False)
        return df, V.as_string(v)


