"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing with exact reranking.

Inner-product search becomes nearest-neighbour search in one more dimension:
indexed vectors are scaled by the largest norm and lifted onto the unit sphere,
queries are scaled to length one; Euclidean distance then falls as the inner
product grows. Some tables of Gaussian projections, cut into cells, give each
vector a bucket a table. A query visits, in each table, its own bucket and the
perturbed ones (each coordinate stays or moves one cell) in order of estimated
success: the sum of squared distances to the cell walls crossed. The candidates of
all tables are merged and reranked by the exact inner product of the original
vectors in double precision. Cell numbers beyond CELLS count as CELLS: far cells
share a border cell, which adds candidates and loses none.

The number of tables, of projections, the width of a cell and the number of probes
follow from the data: FIT_QUERIES queries are searched exactly (one pass over the
table), and of all settings that find TARGET of their neighbours the one that visits
fewest of FIT_VECTORS sampled vectors is taken. The index holds every row.

Buckets meet queries in regions, the buckets that share their first coordinates, as
many as it takes for a region to hold about CHUNK_VECTORS vectors; so a query travels
once to a region with its list of buckets there. Regions that are larger still and
many queries are dealt over chunks; every chunk returns the best of each query only.
No bucket is capped.

A query that finds fewer than ``k`` rows in its buckets though the table has more
(a tiny table, or a query far from a tight cluster) searches all buckets: the whole
index is one region then, in the same chunks, and its result is exact.

A vector takes part if it is not null, has the table's usual number of components,
all finite, not all zero. Defined results: rows that share an id count once, for
the same vector (else for each); fewer than ``k`` candidates give fewer rows;
ties go to the smaller id; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle

SEED = 7
#: Vectors and queries that meet in one block, about.
CHUNK_VECTORS, CHUNK_QUERIES = 20_000, 4_000
#: Cell numbers are held within this bound.
CELLS = 15
_BASE = 2 * CELLS + 1
#: Regions up to this many are broadcast (20 bytes each); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: What settings are fitted on at most, and the share of true neighbours that they must find there.
FIT_QUERIES, FIT_VECTORS, TARGET = 100, 8_000, 0.95
#: Settings tried: projections, tables, and cell widths as multiples of the distance of near neighbours.
HASHES, TABLES, WIDTHS = (4, 6, 8), (1, 2, 4), (0.7, 1.0, 1.5, 2.2)


@dataclass(frozen=True)
class Setting:
    hashes: int
    tables: int
    width: float
    probes: int
    digits: int = 2
    #: Estimates on the sample: the share of true neighbours found, and of all vectors visited (by tables, summed).
    recall: float = 0.0
    visited: float = 0.0

    def family(self, table: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng([SEED, table])
        return rng.normal(size=(self.hashes, size + 1)), rng.uniform(0, 1, self.hashes) * self.width

    def cells(self, x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Cell numbers of lifted vectors, and where in its cell each projection lies (0 to 1)."""
        directions, shift = self.family(table, x.shape[1] - 1)
        at = (x @ directions.T + shift) / self.width
        cell = np.clip(np.floor(at), -CELLS, CELLS)
        return cell.astype(np.int64), np.clip(at - cell, 0, 1)

    @property
    def regions(self) -> int:
        return _BASE**self.digits

    def moves(self) -> np.ndarray:
        return np.array(list(itertools.product((-1, 0, 1), repeat=self.hashes)))

    def order(self, within: np.ndarray) -> np.ndarray:
        """For each query all moves, likeliest first; to stay is the first."""
        walls = np.stack([within**2, np.zeros_like(within), (1 - within) ** 2], axis=2)
        cost = np.zeros((len(within), 1))
        for h in range(self.hashes):  # as the moves are listed, the last coordinate changes fastest
            cost = (cost[:, :, None] + walls[:, h, None, :]).reshape(len(within), -1)
        return np.argsort(cost, axis=1, kind="stable")

    def probed(self, x: np.ndarray, table: int) -> np.ndarray:
        """For each query the codes of the buckets to visit, likeliest first."""
        cell, within = self.cells(lift_queries(x), table)
        return _code(cell[:, None, :] + self.moves()[self.order(within)[:, : self.probes]])

    def ranks(self, q: np.ndarray, x: np.ndarray, table: int) -> np.ndarray:
        """By query and vector the place of the vector's bucket among all that the query could visit; 3**hashes if it could not."""
        own, within = self.cells(lift_queries(q), table)
        order, count = self.order(within), 3**self.hashes
        place = np.empty((len(q), count + 1), np.int32)
        np.put_along_axis(place, order, np.arange(count, dtype=np.int32)[None, :], axis=1)
        place[:, count] = count
        cell = self.cells(x, table)[0]
        move, far = np.zeros((len(q), len(x)), np.int64), np.zeros((len(q), len(x)), bool)
        for h in range(self.hashes):
            step = cell[None, :, h] - own[:, None, h]
            far |= np.abs(step) > 1
            move = move * 3 + step + 1
        return np.take_along_axis(place, np.where(far, count, move), axis=1)


def _code(cells: np.ndarray) -> np.ndarray:
    """Cell numbers along the last axis as one number; the first are its lowest digits."""
    return ((np.clip(cells, -CELLS, CELLS) + CELLS) * _BASE ** np.arange(cells.shape[-1])).sum(axis=-1)


def lift(x: np.ndarray, largest: float) -> np.ndarray:
    scaled = x / largest
    return np.concatenate([scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1, keepdims=True)))], axis=1)


def lift_queries(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))], axis=1)


def choose(q: np.ndarray, near: list[np.ndarray], x: np.ndarray, rows: int, target: float = TARGET) -> Setting:
    """The setting that visits fewest of the lifted ``x`` and finds ``target`` of the lifted neighbours ``near`` of the queries.

    ``rows`` is the size of the table; it decides how long a region's code is.
    """
    lifted = lift_queries(q)
    owner = np.repeat(np.arange(len(q)), [len(n) for n in near])
    every = np.concatenate(near) if len(owner) else np.zeros((0, x.shape[1]))
    far = np.linalg.norm(lifted[owner] - every, axis=1) if len(owner) else np.ones(1)
    scale = max(float(np.quantile(far, 0.9)), 1e-3)
    best = None
    for hashes, times in itertools.product(HASHES, WIDTHS):
        trial = Setting(hashes, max(TABLES), scale * times, 3**hashes)
        found, seen = [], []
        for t in range(max(TABLES)):
            found.append(np.concatenate([trial.ranks(q[i : i + 1], n, t)[0] for i, n in enumerate(near)]) if len(owner) else np.zeros(0))
            seen.append(trial.ranks(q, x, t))
        for tables in TABLES:
            least = np.sort(np.min(found[:tables], axis=0))
            wanted = int(np.ceil(target * len(least)))
            probes = int(least[wanted - 1]) + 1 if wanted else 1
            reached = probes <= 3**hashes
            probes = min(probes, 3**hashes)
            visited = float(sum((s < probes).mean() for s in seen[:tables]))
            recall = float((least < probes).mean()) if len(least) else 1.0
            # a setting that reaches the target goes before one that cannot
            rating = (not reached, -recall if not reached else visited, tables, hashes)
            if best is None or rating < best[0]:
                best = rating, Setting(hashes, tables, trial.width, probes, 2, recall, visited)
    setting = best[1]
    cells = setting.cells(x, 0)[0]
    for digits in range(2, setting.hashes + 1):
        setting = Setting(setting.hashes, setting.tables, setting.width, setting.probes, digits, setting.recall, setting.visited)
        _, sizes = np.unique(_code(cells) % setting.regions, return_counts=True)
        if sizes.max() / len(x) * rows <= CHUNK_VECTORS:
            break
    return setting


def usable(vector: Column, size: int) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return (F.size(vector) == size) & finite & F.exists(vector, lambda x: x != 0)


def _vectors(packed: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), kind).reshape(len(packed), -1).astype(np.float64)


def _packed(df: DataFrame, key: str, vector: str, kind: str) -> DataFrame:
    """id and vec (packed components)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind)
            rows = flat.reshape(batch.num_rows, -1) if batch.num_rows else flat.reshape(0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], names=["id", "vec"])

    return df.select(F.col(key).cast("long").alias("id"), F.col(vector)).mapInArrow(run, "id long, vec binary")


def usable_vectors(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, str, float] | None:
    """The written vectors that take part (id, vec), their components' kind, the largest norm; None without any."""
    double = not isinstance(df.schema[vector].dataType.elementType, T.FloatType)
    kind = "<f8" if double else "<f4"
    sizes = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).groupBy(F.size(vector).alias("size")).count()
    usual = sizes.where("size > 0").orderBy(F.desc("count"), "size").first()
    if usual is None:
        return None
    good = df.where(F.col(key).isNotNull() & usable(F.col(vector), usual["size"]))
    squares = F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    largest = good.agg(F.max(F.sqrt(squares))).first()[0]
    return None if largest is None else (settle(_packed(good, key, vector, kind), "vectors"), kind, largest)


def fit(vectors: DataFrame, asked: DataFrame, kind: str, largest: float, k: int) -> Setting:
    """The setting for this table, from bounded samples of both."""
    rows = vectors.count()
    draw = lambda df, n: df.orderBy(F.xxhash64("id", F.lit(SEED)), "id").limit(n).collect()
    unpack = lambda found: np.array([np.frombuffer(r["vec"], kind) for r in found], np.float64)
    queries = draw(asked, FIT_QUERIES)
    if not queries:
        return Setting(4, 1, 1.0, 1)
    q, ids = unpack(queries), np.array([r["id"] for r in queries])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best of a partition for each sampled query."""
        held: list[list[tuple]] = [[] for _ in ids]
        for batch in batches:
            if batch.num_rows:
                own = batch.column(0).to_numpy()
                score = q @ _vectors(batch.column(1), kind).T
                score[ids[:, None] == own[None, :]] = -np.inf
                for i, at in enumerate(np.argpartition(-score, min(k, batch.num_rows) - 1, axis=1)[:, :k]):
                    new = [(float(score[i, j]), int(own[j]), batch.column(1)[int(j)].as_py()) for j in at if np.isfinite(score[i, j])]
                    held[i] = sorted(held[i] + new, reverse=True)[:k]
        flat = [(i, *h) for i, some in enumerate(held) for h in some]
        columns = list(zip(*flat, strict=True)) if flat else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.float64(), pa.int64(), pa.binary()), strict=True)], names=["q", "score", "id", "vec"])

    found = vectors.mapInArrow(search, "q int, score double, id long, vec binary")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    near: list[list] = [[] for _ in ids]
    for r in found.withColumn("place", place).where(F.col("place") <= k).collect():  # k rows a sampled query
        near[r["q"]].append(np.frombuffer(r["vec"], kind))
    size = q.shape[1]
    lifted = [lift(np.array(n, np.float64).reshape(-1, size), largest) for n in near]
    return choose(q, lifted, lift(unpack(draw(vectors, FIT_VECTORS)), largest), rows)


def build_index(vectors: DataFrame, kind: str, largest: float, setting: Setting) -> DataFrame:
    """The written index: table_no, region, bucket, id, vec."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lifted = lift(_vectors(batch.column(1), kind), largest)
            for table in range(setting.tables):
                code = _code(setting.cells(lifted, table)[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(code), table, np.int32)), pa.array(code % setting.regions), pa.array(code), *batch.columns],
                    names=["table_no", "region", "bucket", "id", "vec"],
                )

    return settle(vectors.mapInArrow(run, "table_no int, region long, bucket long, id long, vec binary"), "index")


def _visits(queries: DataFrame, kind: str, setting: Setting) -> DataFrame:
    """One row per query, table and region it visits, with the buckets there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 200) for b in batches for i in range(0, b.num_rows, 200)):
            x = _vectors(batch.column(1), kind)
            for table in range(setting.tables):
                owner, region, buckets = [], [], []
                for i, codes in enumerate(setting.probed(x, table)):
                    codes = np.unique(codes)  # moves beyond the border cells meet
                    codes = codes[np.argsort(codes % setting.regions, kind="stable")]
                    names, first = np.unique(codes % setting.regions, return_index=True)
                    owner += [i] * len(names)
                    region += names.tolist()
                    buckets += np.split(codes, first[1:])
                rows = batch.take(pa.array(owner, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(owner), table, np.int32)), pa.array(region, pa.int64()), pa.array(buckets, pa.list_(pa.int64())), *rows.columns],
                    names=["table_no", "region", "buckets", "id", "vec"],
                )

    return queries.mapInArrow(run, "table_no int, region long, buckets array<long>, id long, vec binary")


def best_in_block(ids: np.ndarray, x: np.ndarray, bucket: np.ndarray, query_ids: np.ndarray, q: np.ndarray, wanted: list[np.ndarray], k: int) -> list[tuple]:
    """(query, id, score) of each query's ``k`` best among the vectors whose bucket it wants."""
    names, where = np.unique(bucket, return_inverse=True)
    out = []
    for begin in range(0, len(q), 128):
        end = min(begin + 128, len(q))
        visits = np.array([np.isin(names, w) for w in wanted[begin:end]])
        rough = q[begin:end] @ x.T
        rough[~visits[:, where] | (query_ids[begin:end, None] == ids[None, :])] = -np.inf
        least = np.partition(rough, -k, axis=1)[:, -k] if len(ids) > k else np.full(end - begin, -np.inf)
        # the matrix product may round equal scores apart: all that come near the k-th are scored again, one by one
        slack = 1e-9 * (1 + np.abs(least))
        keep = (rough >= np.where(np.isfinite(least), least - slack, -np.inf)[:, None]) & np.isfinite(rough)
        row, column = np.nonzero(keep)
        score = (q[begin:end][row] * x[column]).sum(axis=1)
        order = np.lexsort((ids[column], -score, row))
        row, column, score = row[order], column[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        chosen = place < k
        out.append((query_ids[begin:end][row[chosen]], ids[column[chosen]], score[chosen]))
    return out


def _best(index: DataFrame, visits: DataFrame, kind: str, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of what each query finds in the buckets it visits."""
    # one row a table and region; regions have about CHUNK_VECTORS vectors or are among the first _BASE ** 2
    chunks = index.groupBy("table_no", "region").agg(F.ceil(F.count("*") / CHUNK_VECTORS).cast("int").alias("vs"))
    chunks = chunks.join(visits.groupBy("table_no", "region").agg(F.ceil(F.count("*") / CHUNK_QUERIES).cast("int").alias("qs")), ["table_no", "region"])
    chunks = settle(chunks, "chunks")
    if chunks.count() <= BROADCAST_ROWS:
        chunks = F.broadcast(chunks)
    here = ["table_no", "region", "v", "q"]
    vectors = index.join(chunks, ["table_no", "region"]).withColumns(
        {"v": F.pmod(F.xxhash64("id"), F.col("vs")).cast("int"), "q": F.explode(F.sequence(F.lit(0), F.col("qs") - 1))}
    )
    asking = visits.join(chunks, ["table_no", "region"]).withColumns(
        {"q": F.pmod(F.xxhash64("id"), F.col("qs")).cast("int"), "v": F.explode(F.sequence(F.lit(0), F.col("vs") - 1))}
    )
    vectors = vectors.select(*here, F.lit(False).alias("asks"), "id", "vec", F.array("bucket").alias("buckets"))
    both = vectors.unionByName(asking.select(*here, F.lit(True).alias("asks"), "id", "vec", "buckets"))
    both = both.repartition(*here).sortWithinPartitions(*here, "asks", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def search(block: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(block).combine_chunks()
            asks = rows.column("asks").to_numpy(zero_copy_only=False)
            x, q = rows.filter(pa.array(~asks)), rows.filter(pa.array(asks))
            if not (x.num_rows and q.num_rows):
                return
            bucket = x.column("buckets").combine_chunks().flatten().to_numpy()
            wanted = [np.array(w) for w in q.column("buckets").to_pylist()]
            for a, b, c in best_in_block(x.column("id").to_numpy(), _vectors(x.column("vec").combine_chunks(), kind), bucket,
                                         q.column("id").to_numpy(), _vectors(q.column("vec").combine_chunks(), kind), wanted, k):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(c)], names=["query_id", "vec_id", "score"])

        block, at = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            begin = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[begin]:
                    if at is not None and keys[begin] != at:
                        yield from search(block)
                        block = []
                    at = keys[begin]
                    block.append(batch.slice(begin, i - begin))
                    begin = i
        if block:
            yield from search(block)

    found = both.mapInArrow(run, "query_id long, vec_id long, score double")
    # a pair found in several tables has one rank
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.dense_rank().over(order)).where(F.col("rank") <= k).distinct()
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(df: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest rows found of every row for which ``queries`` holds: query_id, rank, vec_id, score."""
    spark = df.sparkSession
    usable_rows = usable_vectors(df, key, vector)
    if usable_rows is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    every, kind, largest = usable_rows
    asked = every.join(df.where(queries & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id")).distinct(), "id", "left_semi")
    setting = fit(every, asked, kind, largest, k)
    index = build_index(every, kind, largest, setting)
    best = settle(_best(index, settle(_visits(asked, kind, setting), "visits"), kind, k), "best")

    # rows that share an id may make a query look short that is not: it finds the same again
    full = best.groupBy(F.col("query_id").alias("id")).count().where(F.col("count") >= min(k, every.count() - 1))
    short = settle(asked.join(full, "id", "left_anti").select("id", "vec").distinct(), "short")
    if not short.head(1):
        return best
    whole = every.select("id", "vec").distinct().select("id", "vec", F.lit(0).alias("table_no"), F.lit(0).cast("long").alias("region"), F.lit(0).cast("long").alias("bucket"))
    visits = short.select("id", "vec", F.lit(0).alias("table_no"), F.lit(0).cast("long").alias("region"), F.array(F.lit(0).cast("long")).alias("buckets"))
    rest = _best(settle(whole, "whole"), visits, kind, k)
    return best.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").select("query_id", "rank", "vec_id", "score").unionByName(rest)
