"""What the operators share: reading tables, and cutting lineage with tables in the shared folder.

``settle`` writes a DataFrame as Parquet below ``spark.checkpoint.dir`` and reads
it back, so that a lost executor never costs the work before it and the plans
after it stay short. Only where that setting is missing and the session is local
(tests, a shell) does it fall back to a folder of its own; on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..deploy import ship_package

#: A key with more than HOT_ROWS rows, and than this share of all of them, is hot: there are at most 1/HOT_SHARE such keys.
HOT_SHARE, HOT_ROWS = 1e-5, 1000
#: Rows in one Arrow batch, at most.
BATCH_ROWS = 1000
_OWN_DIR: list[str] = []
_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only if none is set and there are no other machines."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="markgrove-"))
    return _OWN_DIR[0]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that no other run uses; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/markgrove-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    _WRITTEN.append(path)
    return path


def written() -> int:
    """How many paths this process has taken so far."""
    return len(_WRITTEN)


def drop_tables(spark: SparkSession, first: int, last: int) -> None:
    """Remove the tables of paths ``first`` to ``last`` (exclusive), by ``written``; nothing may read them any more."""
    for path in _WRITTEN[first:last]:
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session is gone; the folder goes with the cluster's own clean-up
        pass


def settle(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table in the shared folder."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def prepare(spark: SparkSession) -> None:
    """Ship the package to the workers, and let rows reach them in batches of BATCH_ROWS at most.

    Whole texts travel in these batches, so their size bounds what a worker holds.
    The setting is the session's and stays: plans read it when they run, which is
    after the operator has returned. A smaller setting of the user is left alone.
    """
    ship_package(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def number_within(df: DataFrame, group: str, order: list[str], blocks: int | Column, out: str) -> DataFrame:
    """``df`` with a gapless long ``out`` from 0 within each value of ``group``, whatever the group's size.

    A group is split into ``blocks`` blocks (a column: for each group as many as it
    needs) by a hash of ``order``; rows are ranked inside their block and shifted by the number of rows in the blocks before. So a
    group that holds a third of all rows is still many small tasks, and the counts
    that move are one row a group and block.
    """
    rows = df.withColumn("_block", F.pmod(F.xxhash64(*order), blocks if isinstance(blocks, Column) else F.lit(blocks)).cast("int"))
    counts = rows.groupBy(group, "_block").count()
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(
        F.col(group).alias("_g"), F.col("_block").alias("_b"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(group, "_block").orderBy(*order)
    ranked = rows.withColumn("_rank", F.row_number().over(inside) - 1)
    joined = ranked.join(shift, (F.col(group) == F.col("_g")) & (F.col("_block") == F.col("_b")))
    return joined.withColumn(out, (F.col("_before") + F.col("_rank")).cast("long")).drop("_g", "_b", "_before", "_rank", "_block")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, by: str, size: str) -> DataFrame:
    """``rows`` joined to ``groups``, which has one row a ``key`` and in ``size`` the number of rows with it.

    Rows of a hot key are dealt over parts by a hash of ``by``, and its group goes to
    each part, so that no task gets a whole hot group. The hot keys are broadcast:
    they are at most 1/HOT_SHARE. ``groups`` is read twice more: pass it settled, or small.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    least = max(HOT_ROWS, int(total * HOT_SHARE))
    hot = groups.where(F.col(size) > least).select(F.col(key).alias("_hot"), F.ceil(F.col(size) / least).cast("int").alias("_parts"))
    if not hot.head(1):
        return rows.join(groups, key)
    hot = F.broadcast(hot)

    def dealt(df: DataFrame, part: Callable[[Column], Column]) -> DataFrame:
        df = df.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
        return df.withColumn("_part", part(F.col("_parts"))).drop("_hot", "_parts")

    left = dealt(rows, lambda n: F.pmod(F.xxhash64(by), n).cast("int"))
    right = dealt(groups, lambda n: F.explode(F.sequence(F.lit(0), n - 1)))
    return left.join(right, [key, "_part"]).drop("_part")


def slices(batch: pa.RecordBatch, column: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in consecutive parts, without copying, of about ``size`` bytes of a string ``column``; a longer text stands alone."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    begin, held = 0, 0
    for i, n in enumerate(lengths):
        if i > begin and held + n > size:
            yield batch.slice(begin, i - begin)
            begin, held = i, 0
        held += n
    if begin < len(lengths):
        yield batch.slice(begin)
