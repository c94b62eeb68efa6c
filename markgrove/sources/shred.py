"""Shredding: a column of documents becomes the node table, one row per node.

The parse is the only custom executor code. It is stateless and runs in Arrow
batches, bounded in bytes; the columns that a query does not need are neither built
nor moved. An exception belongs to its document and never ends a task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..deploy import ship_package
from .markup import COMMENT, DOCUMENT, ELEMENT, INSTRUCTION, TEXT, parse, read_attributes
from .scan import spread

_INTS = ("pre", "parent", "depth", "last", "sib", "name_pos", "name_cnt", "start", "end", "content_start", "content_end")
#: Columns of the node table after the document's key.
NODE_FIELDS = (
    *(T.StructField(c, T.IntegerType()) for c in _INTS),
    T.StructField("kind", T.ByteType()),
    T.StructField("name", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("node_value", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("attr_order", T.ArrayType(T.StringType())),
    T.StructField("anc", T.ArrayType(T.IntegerType())),
    T.StructField("path", T.StringType()),
    T.StructField("source", T.StringType()),
)
NODE_COLUMNS = tuple(f.name for f in NODE_FIELDS)
_ARROW = {
    T.IntegerType(): pa.int32(), T.ByteType(): pa.int8(), T.StringType(): pa.string(), T.MapType(T.StringType(), T.StringType()): pa.map_(pa.string(), pa.string()),
    T.ArrayType(T.StringType()): pa.list_(pa.string()), T.ArrayType(T.IntegerType()): pa.list_(pa.int32()),
}
_TEST_KINDS = {"*": ELEMENT, "text()": TEXT, "comment()": COMMENT, "processing-instruction()": INSTRUCTION, "#document": DOCUMENT}
#: A path of child and descendant steps from the document: (may skip levels, node test) a step.
Chain = tuple[tuple[bool, str], ...]
#: By bit the chains that a node is at the end of; a column of tables that were shredded for one query only.
CHAIN_FIELD = T.StructField("chains", T.IntegerType())
#: Nodes, and bytes of text, source, paths and ancestors, that one Arrow batch holds, about.
BATCH_NODES, BATCH_BYTES = 20_000, 16 << 20
#: Paths and ancestors of nodes down to this depth are kept while a document is read; deeper ones are put together anew.
KEPT_DEPTH = 64


def chain_bits(kinds: tuple, names: tuple, parents: tuple, chains: tuple[Chain, ...]) -> list[int]:
    """For each node the chains that end there: steps matched by the parent, or by any ancestor, are carried down."""
    count = len(kinds)
    bits = [0] * count
    for c, chain in enumerate(chains):
        by_name: dict[str, list] = {}
        for j, (skips, test) in enumerate(chain):
            by_name.setdefault({"text()": "#text", "comment()": "#comment"}.get(test, test), []).append((j, skips))
        anyone, done = by_name.get("*", []), 1 << len(chain)
        here, above = [0] * count, [0] * count  # bit j: the first j steps lead to this node; to it or an ancestor
        here[0] = above[0] = 1
        for i in range(1, count):
            parent = parents[i]
            reached, name = 0, names[i]
            if name in by_name or anyone:
                for j, skips in (*by_name.get(name, ()), *(anyone if kinds[i] == ELEMENT else ())):
                    if (above if skips else here)[parent] >> j & 1:
                        reached |= 2 << j
            here[i], above[i] = reached, above[parent] | reached
            if reached & done:
                bits[i] |= 1 << c
    return bits


def _kept(kinds: tuple, names: tuple, attributes: tuple, wanted: frozenset[str], bits: list[int]) -> list[int]:
    """The nodes that one of the node tests in ``wanted`` can match.

    ``@x`` stands for elements with that attribute, ``chain n`` for the end of a
    chain, and ``name@x=value`` for elements of a name whose attribute has a value.
    """
    by_kind = {_TEST_KINDS[t] for t in wanted if t in _TEST_KINDS}
    if ELEMENT in by_kind:
        return [i for i, k in enumerate(kinds) if k in by_kind]
    held = frozenset(t[1:] for t in wanted if t[0] == "@")
    ends = sum(1 << int(t[6:]) for t in wanted if t.startswith("chain "))
    valued: dict[str, list[tuple[str, str, bytes]]] = {}
    for t in wanted:
        if "=" in t:
            place, value = t.split("=", 1)
            name, attribute = place.split("@")
            valued.setdefault(name, []).append((attribute, value, value.encode()))

    def has(name: str, raw: bytes | None) -> bool:
        if not raw:
            return False
        if held and not held.isdisjoint(read_attributes(raw)):
            return True
        return any(spelled in raw and read_attributes(raw).get(attribute) == value for attribute, value, spelled in valued.get(name, ()))

    if held or valued or ends:
        return [
            i for i, (k, n, a, b) in enumerate(zip(kinds, names, attributes, bits, strict=True))
            if b & ends or k in by_kind or (k == ELEMENT and (n in wanted or ((held or n in valued) and has(n, a))))
        ]
    return [i for i, (k, n) in enumerate(zip(kinds, names, strict=True)) if k in by_kind or (n in wanted and k == ELEMENT)]


def document_chunks(html: str, needs: Iterable[str] = NODE_COLUMNS, wanted: frozenset[str] | None = None, chains: tuple[Chain, ...] = ()) -> Iterator[dict[str, list]]:
    """The node table's columns, of those in ``needs``, for one document; of all nodes, or of those that ``wanted`` tests match.

    In parts of about BATCH_BYTES: texts, sources, paths and ancestors of nested
    elements together are as large as the square of the document.
    """
    needs = set(needs)
    source = html.encode("utf-8", "surrogatepass")
    rows, chunks = parse(source)
    count = len(rows)
    kind, name, parents, depth, start, end, content_start, content_end, value, attributes, text_from, text_to, last = zip(*rows, strict=True)
    bits = chain_bits(kind, name, parents, chains) if chains else [0] * count
    keep = range(count) if wanted is None else _kept(kind, name, attributes, wanted, bits)
    plain = {
        "parent": parents, "depth": depth, "last": last, "kind": kind, "name": name, "chains": bits,
        "start": start, "end": end, "content_start": content_start, "content_end": content_end,
    }
    if needs & {"sib", "name_pos", "name_cnt", "path"}:
        children, same = [0] * count, {}
        sib, position, keys = [0] * count, [1] * count, [None] * count
        for i in range(1, count):
            parent = parents[i]
            sib[i] = children[parent]
            children[parent] += 1
            keys[i] = (parent, name[i])
            position[i] = same[keys[i]] = same.get(keys[i], 0) + 1
        plain |= {"sib": sib, "name_pos": position, "name_cnt": [same.get(k, 1) for k in keys]}
    paths: dict[int, str] = {0: "/#document"}
    lines: dict[int, list[int]] = {0: []}

    def path_of(i: int) -> str:
        steps = []
        while i not in paths:
            steps.append((i, f"/{name[i]}[{position[i]}]" if same[keys[i]] > 1 else f"/{name[i]}"))
            i = parents[i]
        path = paths[i]
        deep = []
        for i, step in reversed(steps):
            if depth[i] <= KEPT_DEPTH:
                paths[i] = path = path + step
            else:
                deep.append(step)
        return path + "".join(deep)

    def ancestors_of(i: int) -> list[int]:
        up = []
        while i not in lines:
            i = parents[i]
            up.append(i)
        line = [*lines[i], *reversed(up)]
        return line

    if "anc" in needs:
        for i in range(1, count):
            if depth[i] <= KEPT_DEPTH:
                lines[i] = [*lines[parents[i]], parents[i]]
    joined = b"".join(chunks) if "text" in needs else b""
    text_size = [b - a for a, b in zip(text_from, text_to, strict=True)] if "text" in needs else None
    source_size = [b - a for a, b in zip(start, end, strict=True)] if "source" in needs else None
    deep_size = 4 * ("anc" in needs) + 4 * ("path" in needs)

    def part(some: list[int] | range) -> dict[str, list]:
        every = len(some) == count
        pick = list if every else (lambda column: [column[i] for i in some])
        out: dict[str, list] = {"pre": list(some)} | {c: pick(plain[c]) for c in plain.keys() & needs}
        if "path" in needs:
            out["path"] = [path_of(i) for i in some]
        if "anc" in needs:
            out["anc"] = [ancestors_of(i) for i in some]
        if "node_value" in needs:
            out["node_value"] = [value[i].decode("utf-8", "replace") for i in some]
        if "text" in needs:
            out["text"] = [(joined[text_from[i] : text_to[i]] if kind[i] == ELEMENT else value[i]).decode("utf-8", "replace") for i in some]
        if needs & {"attrs", "attr_order"}:
            read = [None if attributes[i] is None else read_attributes(attributes[i]) if attributes[i] else {} for i in some]
            if "attrs" in needs:
                out["attrs"] = read
            if "attr_order" in needs:
                out["attr_order"] = [None if a is None else list(a) for a in read]
        if "source" in needs:
            out["source"] = [source[start[i] : end[i]].decode("utf-8", "replace") for i in some]
        return out

    heavy = (text_size is not None) + (source_size is not None) + bool(deep_size)
    if not heavy or (len(source) * heavy + 8 * max(depth)) * len(keep) <= BATCH_BYTES:
        yield part(keep)
        return
    begin, held = 0, 0
    for at, i in enumerate(keep):
        size = (text_size[i] if text_size else 0) + (source_size[i] if source_size else 0) + deep_size * depth[i]
        if at > begin and held + size > BATCH_BYTES:
            yield part(keep[begin:at])
            begin, held = at, 0
        held += size
    yield part(keep[begin:])


def document_columns(html: str, needs: Iterable[str] = NODE_COLUMNS, wanted: frozenset[str] | None = None, chains: tuple[Chain, ...] = ()) -> dict[str, list]:
    """All parts of ``document_chunks`` as one."""
    whole: dict[str, list] = {}
    for part in document_chunks(html, needs, wanted, chains):
        whole = part if not whole else {c: whole[c] + part[c] for c in whole}
    return whole


def document_error(html: str | None) -> str | None:
    """Why a document cannot be queried; None if it can."""
    if html is None or not html.strip(" \t\r\n"):
        return "the document is empty"
    try:
        for _ in document_chunks(html, ("pre", "attrs", "path")):
            pass
    except Exception as e:  # noqa: BLE001  whatever it is belongs to this document, not to the job
        return f"{type(e).__name__}: {e}"
    return None


def _map_array(rows: list[dict[str, str] | None]) -> pa.MapArray:
    """Dicts as an Arrow map column, by way of flat keys and values."""
    offsets: list[int | None] = []
    keys: list[str] = []
    values: list[str] = []
    for row in rows:
        offsets.append(None if row is None else len(keys))
        if row:
            keys.extend(row)
            values.extend(row.values())
    offsets.append(len(keys))
    return pa.MapArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))


def shred(docs: DataFrame, key: str, html: str, needs: Iterable[str] = NODE_COLUMNS, wanted: frozenset[str] | None = None, chains: tuple[Chain, ...] = ()) -> DataFrame:
    """The node table of ``docs``: ``doc`` (the key) and the columns in ``needs``. Null and blank documents have no nodes.

    ``wanted`` are node tests; nodes that none of them matches are dropped where they
    are parsed. A document whose parse fails has no nodes either: one document never
    fails a job, and ``document_error`` says what happened.
    """
    ship_package(docs.sparkSession)
    fields = [f for f in (*NODE_FIELDS, CHAIN_FIELD) if f.name in set(needs)]
    names = [f.name for f in fields]
    key_field = T.StructField("doc", docs.schema[key].dataType)
    types = [_ARROW[f.dataType] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(keys: pa.Array, owners: list[tuple[int, int]], columns: dict[str, list]) -> pa.RecordBatch:
            arrays = [_map_array(columns[c]) if c == "attrs" else pa.array(columns[c], t) for c, t in zip(names, types, strict=True)]
            return pa.RecordBatch.from_arrays([keys.take(pa.array([i for i, n in owners for _ in range(n)], pa.int64())), *arrays], names=["doc", *names])

        for batch in batches:
            owners, columns, nodes, size = [], {c: [] for c in names}, 0, 0
            for i, text in enumerate(batch.column(1)):
                html = text.as_py()
                parts = document_chunks(html, names, wanted, chains)
                while True:
                    try:
                        found = next(parts, None)
                    except Exception:  # noqa: BLE001  see ``document_error``
                        found = None
                    if found is None:
                        break
                    owners.append((i, len(found["pre"])))
                    nodes += len(found["pre"])
                    size += len(html)
                    size += sum(map(len, found.get("text", ()))) + sum(map(len, found.get("source", ()))) + sum(map(len, found.get("path", ()))) + 4 * sum(map(len, found.get("anc", ())))
                    for c in names:
                        columns[c].extend(found[c])
                    if nodes >= BATCH_NODES or size >= BATCH_BYTES:
                        yield flush(batch.column(0), owners, columns)
                        owners, columns, nodes, size = [], {c: [] for c in names}, 0, 0
            if owners:
                yield flush(batch.column(0), owners, columns)

    real = docs.where(F.col(key).isNotNull() & (F.trim(F.col(html), F.lit(" \t\r\n")) != ""))
    return spread(real.select(F.col(key).alias("doc"), F.col(html))).mapInArrow(run, T.StructType([key_field, *fields]))


def parse_errors(docs: DataFrame, key: str, html: str) -> DataFrame:
    """``key`` and ``error`` of the documents that cannot be queried: blank ones, and those whose parse fails."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([document_error(t.as_py()) for t in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=[key, "error"]).filter(found.is_valid())

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("error", T.StringType())])
    return spread(docs.select(F.col(key), F.col(html))).mapInArrow(run, schema)


class HtmlNodes:
    """SQL table function: ``SELECT d.id, n.* FROM docs d, LATERAL html_nodes(d.html) n``."""

    def eval(self, html: str):
        if html is None or not html.strip():
            return
        for columns in document_chunks(html):
            yield from zip(*(columns[c] for c in NODE_COLUMNS), strict=True)


def register_table_function(spark: SparkSession, name: str = "html_nodes") -> None:
    """Register the shredder for use in SQL as a lateral table function."""
    ship_package(spark)
    spark.udtf.register(name, F.udtf(HtmlNodes, returnType=T.StructType(list(NODE_FIELDS))))


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Whole files as documents: ``doc_id`` (the file's path) and ``html``."""
    files = spark.read.text(paths, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("html"))
