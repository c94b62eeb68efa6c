"""MinHash near-duplicate detection with tensored banding and exact confirmation.

Tensored banding: two collections of TABLES half-keys, each a hash of HALF
minhashes, are combined pairwise into TABLES squared table keys. So 2 * HALF *
TABLES minhashes do the work of 2 * HALF * TABLES**2. Texts with a table key in
common are candidates. For a similarity s, a pair is missed with probability
1 - (1 - (1 - s**HALF)**TABLES)**2; ``miss_probability`` gives it.

Steps: texts with equal shingle sets become one class (its least id stands for
it). Each bucket links its members to its least member, so candidates grow with
the bucket's size, not its square; these star links are confirmed on full sets.
That settles buckets that are one near-copy group. What is left are the members of
buckets that confirmed links do not join up. For these an exact prefix filter
follows: shingles are ordered by how many of these texts have them, those that occur
in one confirmed component only first of all; two linked texts of different
components must share one of the first n - ceil(n * percent / 100) + 1 shingles of
each. Texts with too few shared shingles, such as pages that have a boilerplate in
common, leave here. Only texts that share a shingle of that prefix meet in bounded
blocks, where all pairs of different confirmed components are tested exactly through
an inverted index. No bucket, partner or candidate is capped. All this grows with the
texts but for one case: a group of many texts whose similarities all lie a little
below the threshold is tested pair by pair, in blocks.

Defined results: null, empty and blank texts have the empty set and are linked
with nothing; rows without an id as well (their component is null, and they are
kept); rows that share an id count as one document for links, and each gets its
component; equal sets are linked; an empty table gives no rows; extra columns are
not read. ``keep_one`` keeps one of several rows with one id and one text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, settle, slices
from .components import components
from .shingles import mix, shingle_sets

HALF, TABLES = 3, 8
SEED = 20_240_601
#: Star links of one class that are confirmed in one task run.
STAR_ROWS = 1000
#: Shingles of one chunk of a candidate component; a block holds two chunks.
CHUNK_SHINGLES = 200_000
#: Ids up to this many are broadcast (24 bytes each); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 500_000


def miss_probability(similarity: float, half: int = HALF, tables: int = TABLES) -> float:
    return 1 - (1 - (1 - similarity**half) ** tables) ** 2


def half_keys(sets: list[np.ndarray], half: int, tables: int) -> np.ndarray:
    """Both collections of half-keys of non-empty ``sets``, one row a set."""
    rng = np.random.default_rng(SEED)
    count = 2 * half * tables
    factors = rng.integers(0, 2**63, count, dtype=np.uint64) | np.uint64(1)
    masks = rng.integers(0, 2**63, count, dtype=np.uint64)
    every = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    keys = np.zeros((len(sets), 2 * tables), np.uint64)
    for i in range(count):
        least = np.minimum.reduceat((every ^ masks[i]) * factors[i], starts)
        column = i // half
        keys[:, column] = mix(keys[:, column] * np.uint64(31) + least)
    return keys.view(np.int64)


def _set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame, words: int, half: int, tables: int, key: str, text: str) -> DataFrame:
    """key, n_shingles, set_key, halves (null for the empty set) and digest (of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, 1)):
            sets = shingle_sets(batch.column(1), words)
            full = [s for s in sets if len(s)]
            keys = iter(half_keys(full, half, tables)) if full else iter(())
            halves = [next(keys) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_set_key(s) for s in sets], pa.binary()), pa.array(halves, pa.list_(pa.int64())), batch.column(2)],
                names=[key, "n_shingles", "set_key", "halves", "digest"],
            )

    rows = docs.select(F.col(key).cast("long").alias(key), F.col(text).alias(text), _digest(text).alias("digest"))
    return rows.mapInArrow(run, f"`{key}` long, n_shingles long, set_key binary, halves array<long>, digest binary")


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def _entries(classes: DataFrame, tables: int) -> DataFrame:
    """One row per class and table: the table key and the class."""
    table = lambda t: F.xxhash64(F.get("halves", F.floor(t / tables).cast("int")), F.get("halves", F.lit(tables) + t % tables), t)
    return classes.select("class", F.explode(F.transform(F.sequence(F.lit(0), F.lit(tables * tables - 1)), table)).alias("bucket"))


def _sets(docs: DataFrame, wanted: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """class and set (packed hashes) of the classes in ``wanted`` (class, set_key), from their documents' whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, 1)):
            sets = shingle_sets(batch.column(1), words)
            same = [_set_key(s) == k.as_py() for s, k in zip(sets, batch.column(2), strict=True)]
            packed = pa.array([s.tobytes() for s, ok in zip(sets, same, strict=True) if ok], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(same)), packed], names=["class", "set"])

    wanted = wanted.select(F.col("class").alias("_class"), F.col("set_key").alias("_set_key"))
    if wanted.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    rows = docs.select(F.col(key).cast("long").alias("_id"), F.col(text).alias("_text")).join(wanted, F.col("_id") == F.col("_class"))
    return rows.select("_class", "_text", "_set_key").mapInArrow(run, "class long, set binary")


def linked(common: np.ndarray, a: int, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether intersections of sets of sizes ``a`` and ``b`` reach the similarity, in integers."""
    return 100 * common >= percent * (a + b - common)


def _confirm_stars(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links among candidate ``pairs`` (hub, class). A hub's members are dealt over parts; its set goes to each."""
    parts = pairs.groupBy("hub").agg(F.count("*").alias("_n"))
    dealt = join_groups(pairs, parts, "hub", "class", "_n").withColumn("part", F.pmod(F.xxhash64("class"), F.ceil(F.col("_n") / STAR_ROWS)).cast("int"))
    members = dealt.select("hub", "part", "class").join(sets, "class").select("hub", "part", "class", "set")
    hubs = dealt.select("hub", "part").distinct().join(sets.withColumnRenamed("class", "hub"), "hub")
    hubs = hubs.select("hub", "part", F.lit(None).cast("long").alias("class"), "set")
    rows = members.unionByName(hubs).repartition("hub", "part").sortWithinPartitions("hub", "part", F.asc_nulls_first("class"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub_set = np.zeros(0, np.uint64)
        for batch in batches:
            a, b = [], []
            for hub, member, packed in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                own = np.frombuffer(packed.as_buffer(), np.uint64)
                if member is None:
                    hub_set = own.copy()
                elif linked(len(np.intersect1d(hub_set, own, assume_unique=True)), len(hub_set), len(own), percent):
                    a.append(hub)
                    b.append(member)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def block_links(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, joined: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between members of different confirmed components ``joined``, one for each member and component.

    ``side`` is 0 or 1; if both occur, only pairs across sides are tested. Members
    of the most frequent component are tested only as partners.
    """
    sizes = np.array([len(s) for s in sets])
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    owners = np.repeat(np.arange(len(sets)), sizes)
    by_code = np.argsort(codes, kind="stable")
    postings, first = owners[by_code], np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(values)))])
    edges = np.concatenate([[0], np.cumsum(sizes)])
    names, counts = np.unique(joined, return_counts=True)
    most = names[np.argmax(counts)]
    across = len(np.unique(side)) > 1
    out = []
    for i in np.flatnonzero(joined != most).tolist():
        mine = codes[edges[i] : edges[i + 1]]
        lengths = first[mine + 1] - first[mine]
        at = np.repeat(first[mine] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
        common = np.bincount(postings[at], minlength=len(sets))
        hit = linked(common, sizes[i], sizes, percent) & (joined != joined[i])
        if across:
            hit &= side != side[i]
        found = np.flatnonzero(hit)
        for j in found[np.unique(joined[found], return_index=True)[1]].tolist():
            out.append((int(ids[i]), int(ids[j])))
    return out


def _open_sets(pairs: DataFrame, confirmed: DataFrame, sets: DataFrame) -> DataFrame:
    """class, joined (its confirmed component) and set of the members of buckets that confirmed links leave apart."""
    part = confirmed.select(F.col("node").alias("_node"), F.col("component").alias("_part"))
    hubs = pairs.select("hub").distinct().join(part, F.col("hub") == F.col("_node"), "left").select("hub", F.coalesce("_part", "hub").alias("_hub_part"))
    sizes = pairs.groupBy("hub").agg(F.count("*").alias("_n"))
    hubs = settle(hubs.join(sizes, "hub"), "hubs")
    members = join_groups(pairs, hubs, "hub", "class", "_n").select("hub", "_hub_part", "class")
    members = members.join(part, F.col("class") == F.col("_node"), "left").select("hub", "_hub_part", "class", F.coalesce("_part", "class").alias("joined"))
    members = settle(members, "members")
    apart = members.where(F.col("joined") != F.col("_hub_part")).groupBy("hub").agg(F.first("_hub_part").alias("_hub_part"))
    apart = settle(apart.join(sizes, "hub"), "apart")
    opened = join_groups(members.select("hub", "class", "joined"), apart.select("hub", "_n"), "hub", "class", "_n").select("class", "joined")
    opened = opened.unionByName(apart.select(F.col("hub").alias("class"), F.col("_hub_part").alias("joined"))).distinct()
    return settle(opened.join(sets, "class"), "open")


def _exploded(opened: DataFrame) -> DataFrame:
    """One row per shingle of each set: shingle, class, joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, 2)):
            sets = [np.frombuffer(p.as_buffer(), np.int64) for p in batch.column(2)]
            sizes = np.array([len(s) for s in sets], np.int64)
            owner = pa.array(np.repeat(np.arange(len(sets)), sizes))
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat), batch.column(0).take(owner), batch.column(1).take(owner)], names=["shingle", "class", "joined"]
            )

    return opened.select("class", "joined", "set").mapInArrow(run, "shingle long, class long, joined long")


def _prefix_groups(opened: DataFrame, percent: int) -> DataFrame:
    """node and component of the texts that share a shingle of their prefixes, directly or through others."""
    rows = _exploded(opened)
    shared = rows.groupBy("shingle").agg(F.count("*").alias("df"), F.min("joined").alias("_low"), F.max("joined").alias("_high")).where("_low <> _high").select("shingle", "df")
    shared = settle(shared, "shared")
    mine = join_groups(rows.select("shingle", "class"), shared, "shingle", "class", "df")
    mine = mine.groupBy("class").agg(F.collect_set(F.struct(F.least("df", F.lit(2**31 - 1)).cast("int").alias("df"), "shingle")).alias("mine"))
    size = opened.groupBy(F.col("class").alias("_class")).agg((F.max(F.octet_length("set")) / 8).cast("long").alias("n"))
    mine = mine.join(size, F.col("class") == F.col("_class"))
    # what two sets have in common is at least this much of each
    needed = F.ceil(F.col("n") * percent / 100)
    mine = mine.withColumn("_r", (F.size("mine") - needed + 1).cast("int")).where("_r > 0")
    prefix = settle(mine.select("class", F.explode(F.slice(F.array_sort("mine"), F.lit(1), F.col("_r"))).alias("_s")).select("class", "_s.shingle"), "prefix")
    hubs = prefix.groupBy("shingle").agg(F.min("class").alias("hub"), F.max("class").alias("_last"), F.count("*").alias("_n")).where("hub <> _last")
    links = join_groups(prefix, settle(hubs.drop("_last"), "prefix_hubs"), "shingle", "class", "_n").where("class <> hub").select("hub", "class").distinct()
    return components(links, "hub", "class", "prefix_groups")


def _residual_links(pairs: DataFrame, confirmed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links that stars did not settle."""
    opened = _open_sets(pairs, confirmed, sets)
    if not opened.head(1):
        return sets.sparkSession.createDataFrame([], "a long, b long")
    groups = _prefix_groups(opened, percent).select(F.col("node").alias("class"), F.col("component").alias("group"))
    nodes = settle(groups.join(opened.select("class", "joined", (F.octet_length("set") / 8).cast("long").alias("n")), "class"), "nodes")
    chunks = nodes.groupBy("group").agg(F.ceil(F.sum(F.col("n") + 32) / CHUNK_SHINGLES).cast("int").alias("_chunks"), F.min("joined").alias("_low"), F.max("joined").alias("_high"), F.count("*").alias("_n"))
    chunks = chunks.where("_low <> _high").select("group", "_chunks", "_n")
    nodes = join_groups(nodes, chunks, "group", "class", "_n").withColumn("chunk", F.pmod(F.xxhash64("class"), F.col("_chunks")).cast("int"))
    nodes = nodes.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    blocks = nodes.select("group", F.least("chunk", "_other").alias("low"), F.greatest("chunk", "_other").alias("high"), "chunk", "class")
    blocks = blocks.join(opened, "class").select("group", "low", "high", "chunk", "joined", "class", "set")
    rows = blocks.repartition("group", "low", "high").sortWithinPartitions("group", "low", "high", "class")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def test(block: list) -> pa.RecordBatch:
            once = {(r[1], r[3].tobytes()): r for r in block}.values()  # rows that share id and text come once
            chunk, ids, joined, sets = (list(c) for c in zip(*once, strict=True))
            found = block_links(np.array(ids), sets, (np.array(chunk) != chunk[0]).astype(int), np.array(joined), percent)
            a, b = zip(*found, strict=True) if found else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        block, at = [], None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(6)]
            for group, low, high, chunk, joined, own, packed in zip(*columns, batch.column(6), strict=True):
                if at is not None and at != (group, low, high):
                    yield test(block)
                    block = []
                at = (group, low, high)
                block.append((chunk, own, joined, np.frombuffer(packed.as_buffer(), np.uint64).copy()))
        if block:
            yield test(block)

    return rows.mapInArrow(run, "a long, b long")


def _labelled(docs: DataFrame, words: int, percent: int, half: int, tables: int, key: str, text: str) -> DataFrame:
    """``near_duplicates`` with the digest of each text."""
    drawn = settle(sketches(docs, words, half, tables, key, text), "sketches")
    real = drawn.where(F.col(key).isNotNull() & F.col("halves").isNotNull())
    classes = real.groupBy("set_key").agg(F.min(F.struct(F.col(key).alias("class"), "n_shingles", "halves")).alias("_c"), F.count("*").alias("rows"))
    classes = settle(classes.select("set_key", "_c.class", "_c.halves", "rows"), "classes")

    buckets = _entries(classes, tables).groupBy("bucket").agg(F.min("class").alias("hub"), F.max("class").alias("_last"), F.count("*").alias("_n")).where("hub <> _last")
    buckets = settle(buckets.drop("_last"), "buckets")
    pairs = join_groups(_entries(classes, tables), buckets, "bucket", "class", "_n").where("class <> hub").select("hub", "class").distinct()
    pairs = settle(pairs, "pairs")

    nodes = pairs.select("class").union(pairs.select(F.col("hub").alias("class"))).distinct()
    sets = settle(_sets(docs, classes.select("class", "set_key").join(nodes, "class", "left_semi"), words, key, text), "sets")
    size = sets.select(F.col("class").alias("_id"), (F.octet_length("set") / 8).cast("long").alias("_n"))
    hub_size = pairs.select(F.col("hub").alias("_hub")).distinct().join(size, F.col("_hub") == F.col("_id")).select("_hub", F.col("_n").alias("_hub_n"))
    hub_size = settle(hub_size.join(pairs.groupBy("hub").agg(F.count("*").alias("_members")), F.col("hub") == F.col("_hub")).select("hub", "_hub_n", "_members"), "hub_sizes")
    near = join_groups(pairs, hub_size, "hub", "class", "_members").select("hub", "class", "_hub_n").join(size, F.col("class") == F.col("_id"))
    near = settle(near.where(100 * F.least("_n", "_hub_n") >= percent * F.greatest("_n", "_hub_n")).select("hub", "class").distinct(), "near")
    stars = settle(_confirm_stars(near, sets, percent), "stars")
    confirmed = components(stars, "a", "b", "confirmed")
    rest = settle(_residual_links(pairs, confirmed, sets, percent), "rest")
    final = components(stars.unionByName(rest), "a", "b", "final") if rest.head(1) else confirmed

    # one row a set of words; the copies of one text are dealt over parts
    named = classes.select("set_key", "class", "rows").join(final, F.col("class") == F.col("node"), "left")
    named = settle(named.select("set_key", F.coalesce("component", "class").alias("_component"), F.col("rows").alias("_n")), "named")
    rest = drawn.where(F.col(key).isNull() | F.col("halves").isNull()).select(key, "n_shingles", "digest", F.col(key).alias("_component"))
    rows = join_groups(real.select(key, "n_shingles", "digest", "set_key"), named, "set_key", key, "_n").select(key, "n_shingles", "digest", "_component").unionByName(rest)
    component = F.coalesce("_component", key)
    return rows.select(key, "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col(key)).alias("kept"), "digest")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, half: int = HALF, tables: int = TABLES,
                    key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id, kept. Links have 100 * common >= percent * union."""
    return _labelled(docs, words, percent, half, tables, key, text).drop("digest")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80, half: int = HALF, tables: int = TABLES,
             key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each near-duplicate group, that of least id; columns as they were."""
    labelled = settle(_labelled(docs, words, percent, half, tables, key, text), "labelled").where(F.col(key).isNotNull())
    texts = labelled.groupBy(F.col(key).alias("_id"), F.col("digest").alias("_text")).agg(F.bool_or("kept").alias("_kept"), F.count("*").alias("_rows"))
    odd = settle(texts.where("NOT _kept OR _rows > 1"), "odd")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(key).cast("long").alias("_own"), _digest(text).alias("_own_text"))
    rows = rows.join(F.broadcast(odd) if odd.count() <= BROADCAST_ROWS else odd, (F.col("_own") == F.col("_id")) & (F.col("_own_text") == F.col("_text")), "left")
    kept = rows.where(F.col("_kept").isNull()).select("row.*")
    if not odd.where("_kept").head(1):
        return kept
    # of the rows that repeat an id and a text, one
    return kept.unionByName(rows.where("_kept").dropDuplicates(["_own", "_own_text"]).select("row.*"))
