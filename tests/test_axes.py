"""Axes, positions and counts against a naive evaluator over random trees, in both profiles."""

import random
import re

import pytest

from markgrove.api import compile_xpath
from markgrove.plans.ast import Binary, Call, Literal, Number, Path, Union
from markgrove.plans.compiler import is_numeric
from markgrove.sources.shred import document_columns

BACKWARDS = {"compat": {"ancestor", "preceding"}, "xpath1": {"ancestor", "preceding", "ancestor-or-self", "preceding-sibling"}}


def random_documents(n=12, seed=4):
    rng = random.Random(seed)

    def element(depth):
        name = rng.choice("abc")
        inner = "".join(rng.choice([element(depth + 1), "t", "<!--c-->"]) if rng.random() < 0.8 else "u" for _ in range(rng.randrange(5))) if depth < 4 else ""
        return f'<{name} x="{rng.randrange(3)}">{inner}</{name}>'

    return [(i, "".join(element(0) for _ in range(3))) for i in range(n)]


class Naive:
    def __init__(self, html, profile):
        columns = document_columns(html)
        self.nodes = [{c: columns[c][i] for c in columns} for i in range(len(columns["pre"]))]
        self.backwards = BACKWARDS[profile]

    def axis(self, i, axis):
        n, own = self.nodes, self.nodes[i]
        siblings = [k["pre"] for k in n if k["parent"] == own["parent"] and own["parent"] is not None]
        return {
            "child": [k["pre"] for k in n if k["parent"] == i], "parent": [] if own["parent"] is None else [own["parent"]], "self": [i], "ancestor": list(own["anc"]),
            "ancestor-or-self": [*own["anc"], i], "descendant": [k["pre"] for k in n if i < k["pre"] <= own["last"]], "descendant-or-self": [k["pre"] for k in n if i <= k["pre"] <= own["last"]],
            "following-sibling": [k for k in siblings if k > i], "preceding-sibling": [k for k in siblings if k < i],
            "following": [k["pre"] for k in n if k["pre"] > own["last"]], "preceding": [k["pre"] for k in n if k["last"] < i and k["parent"] is not None],
        }[axis]

    def passes(self, i, test):
        kind, name = self.nodes[i]["kind"], self.nodes[i]["name"]
        return test == "node()" or (kind == 1 if test == "*" else kind == 3 if test == "text()" else kind == 1 and name == test)

    def step(self, contexts, step):
        out = set()
        for i in contexts:
            found = sorted((k for k in self.axis(i, step.axis) if self.passes(k, step.test)), reverse=step.axis in self.backwards)
            for p in step.predicates:
                found = [k for at, k in enumerate(found, 1) if self.holds(k, p, at, len(found))]
            out.update(found)
        return out

    def path(self, e, i=None):
        if isinstance(e, Union):
            return set().union(*(self.path(p, i) for p in e.parts))
        contexts = {0} if e.start == "root" else {i}
        for s in e.steps:
            contexts = {("@", k, s.test) for k in contexts if s.test in self.nodes[k]["attrs"]} if s.axis == "attribute" else self.step(contexts, s)
        return contexts

    def holds(self, i, e, at, size):
        value = self.value(i, e, at, size)
        return value == at if is_numeric(e) else bool(value)

    def string(self, v):
        if isinstance(v, set):
            first = min(v, key=lambda k: k[1] if isinstance(k, tuple) else k, default=None)
            return "" if first is None else self.nodes[first[1]]["attrs"][first[2]] if isinstance(first, tuple) else self.nodes[first]["text"]
        return str(v)

    def value(self, i, e, at, size):
        if isinstance(e, (Number, Literal)):
            return e.value
        if isinstance(e, (Path, Union)):
            return self.path(e, i)
        if isinstance(e, Call):
            if e.name in ("position", "last"):
                return at if e.name == "position" else size
            inner = self.value(i, e.args[0], at, size)
            return len(inner) if e.name == "count" else not inner
        left, right = self.value(i, e.left, at, size), self.value(i, e.right, at, size)
        if e.op in ("and", "or"):
            return (left and right) if e.op == "and" else (left or right)
        number = lambda v: float(self.string(v) or "nan") if isinstance(v, set) else float(v)
        if e.op == "=" and not (isinstance(left, (int, float)) or isinstance(right, (int, float))):
            return self.string(left) == self.string(right)
        return {"=": number(left) == number(right), "<=": number(left) <= number(right), ">": number(left) > number(right), "-": number(left) - number(right)}[e.op]


EXPRESSIONS = """
//a[2] | //b[last()] | //c[position()<=2] | //a[last()-1] | //text()[2]
//a/b[1] //a//b[2] //a//b[last()] //*[2] //node()[3] //a[@x='1'][2] //b[2][@x='1']
//a/following-sibling::b[1] //a/following-sibling::a[1] //a/following-sibling::a[2] //a/following-sibling::b[last()] //a/preceding-sibling::b[1] //a/preceding-sibling::a[1]
//a/preceding-sibling::a[last()] //a/preceding-sibling::b[2] //a/following-sibling::*[1] //a/following-sibling::text()[1] //a/following-sibling::b[@x='1'][1] //a/preceding-sibling::b[@x='1'][1]
//a/following-sibling::b[1][@x='1'] //a/following-sibling::b[position()<=2] //a/following-sibling::b //a/preceding-sibling::node()
//a[following-sibling::a] //a[following-sibling::b] //a[not(preceding-sibling::a)] //a[not(preceding-sibling::b[@x='1'])] //a[preceding-sibling::*] //a[following::b] //a[preceding::b[@x='1']]
//a[not(following::c)] //*[following-sibling::text()] //a[following-sibling::b[1]] //a[following-sibling::b[2]/@x='1'] //a[following-sibling::b/@x='1'] //a[preceding-sibling::b/@x='1']
//a[count(preceding-sibling::a)=1] //a[count(following-sibling::a)=0] //a[count(following-sibling::b)=2] //a[count(preceding-sibling::b[@x='1'])=1] //a[count(following::b)=3] //a[count(preceding::b)=2]
//a[count(following-sibling::text())=1] //a[following-sibling::a or preceding-sibling::b] //b[following-sibling::c[following-sibling::a]] //b[count(following-sibling::c[preceding-sibling::a])=1]
//a/b/following-sibling::c[1]/following-sibling::a[1] //a[b[1]/following-sibling::b[1]] //a[b/following-sibling::c[1]/@x='2'] //a/following::b[1] //a/preceding::b[1] //b[.//a[2]] //b[count(a[1])=1]
/a/b | /a//b/c | /*/b[2] | //a/*/c | //a//text() | /a/b/text() | //b/*[1] | //a//a//a | /a/b[@x='1']/c
//a/b/@x //a//b[@x='1']/@x //a/c/.. //a/b/ancestor::a //a[@x='1' and position()=2] //b//c[last()]/@x
//a/b[position()>1] //a//b[position()>1][@x='1'] //c[count(following-sibling::*)=1] //a/ancestor-or-self::*[1] //a/ancestor::*[2]
"""
CASES = [x for line in EXPRESSIONS.strip().splitlines() for x in ([line] if " | " in line else re.split(" (?=//)", line))]


@pytest.fixture(scope="module")
def tables(spark):
    rows = random_documents()
    return dict(rows), spark.createDataFrame(rows, "doc_id long, html string").repartition(2).cache()


@pytest.mark.parametrize("profile", ["compat", "xpath1"])
@pytest.mark.parametrize("part", range(6))
def test_axes_equal_a_naive_evaluator(tables, profile, part):
    documents, df = tables
    for expression in CASES[part::6]:
        compiled = compile_xpath(expression, profile)
        got = sorted((r.doc_id, r.start_location) for r in compiled.evaluate(df, columns=["start_location"]).collect())
        want = []
        place = lambda k, nodes: 0 if isinstance(k, tuple) else nodes[k]["start"]  # noqa: E731  attributes have no place
        for i, html in documents.items():
            naive = Naive(html, profile)
            want += [(i, place(k, naive.nodes)) for k in naive.path(compiled.tree)]
        assert got == sorted(want), expression


def _plan(df, expression):
    return compile_xpath(expression).evaluate(df, columns=["start_location"])._jdf.queryExecution().optimizedPlan().toString()


def test_positions_and_siblings_need_no_windows_and_no_joins(tables):
    _, df = tables
    for expression in ("//a[3]", "//a[last()]", "//a[position()<=3]", "//a[position() mod 2 = 0]", "//a[2][@x='1']", "//a[following-sibling::a]", "//a[count(preceding-sibling::a)=4]", "//a[not(preceding-sibling::a)]"):
        plan = _plan(df, expression)
        assert "Window" not in plan and "Join" not in plan, expression
    for expression in ("//a//b/@x", "/a/b/c", "//a/b[2]", "//a/b[@x='1']/@x"):
        plan = _plan(df, expression)
        assert "Join" not in plan and "Window" not in plan, expression
    assert "Window" not in _plan(df, "//u/a[3]") and "Window" not in _plan(df, "//a/following-sibling::a[1]")
    for expression in ("//a[not(preceding-sibling::b[@x='1'])]", "//a[following-sibling::b]", "//a/following-sibling::a[1]"):
        assert _plan(df, expression).count("Join") == 1, expression


def test_xpath1_compares_any_nodes_of_two_sets(spark):
    documents = dict(random_documents(80, seed=7))
    df = spark.createDataFrame(list(documents.items()), "doc_id long, html string").repartition(2)
    tests = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: float(a) < float(b), ">=": lambda a, b: float(a) >= float(b)}
    for op, holds in tests.items():
        got = sorted((r.doc_id, r.start_location) for r in compile_xpath(f"//a[.//b/@x {op} .//c/@x]", "xpath1").evaluate(df, columns=["start_location"]).collect())
        absolute = sorted((r.doc_id, r.start_location) for r in compile_xpath(f"//a[.//b/@x {op} /c/@x]", "xpath1").evaluate(df, columns=["start_location"]).collect())
        want, rooted = [], []
        for i, html in documents.items():
            n = Naive(html, "xpath1").nodes
            below = lambda i, name, n=n: [k["attrs"]["x"] for k in n if i < k["pre"] <= n[i]["last"] and k["name"] == name]
            top = [k["attrs"]["x"] for k in n if k["parent"] == 0 and k["name"] == "c"]
            for k in n:
                if k["name"] == "a":
                    want += [(i, k["start"])] if any(holds(x, y) for x in below(k["pre"], "b") for y in below(k["pre"], "c")) else []
                    rooted += [(i, k["start"])] if any(holds(x, y) for x in below(k["pre"], "b") for y in top) else []
        assert got == sorted(want) and absolute == sorted(rooted) and want
