"""Sharding by jump consistent hashing, in SQL expressions only.

A row's shard depends on its key and the number of shards alone. Growing from n
to n+1 shards moves each row either nowhere or into the new shard, and moves
1/(n+1) of the rows on average. There is no ring table to keep or broadcast.

The hash is the published loop: a 64-bit linear congruential generator seeded by
the key draws the next shard count at which the key jumps. Spark's integers are
signed and checked for overflow, so the generator's state is held as two 32-bit
halves and multiplied in 16-bit limbs.

Defined results: a null key counts as key 0; a null text as no bytes and crc 0;
repeated rows share a shard and get different slots; an empty table gives no
rows; columns of the input beyond key and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import number_within, text_or_empty

#: Multiplier of the generator in the published algorithm.
JUMP_MULTIPLIER = 2862933555777941757
_LIMBS = [(JUMP_MULTIPLIER >> (16 * i)) & 0xFFFF for i in range(4)]
#: The draws follow about ln(shards); a key that needs more than this many fails loudly rather than land wrongly.
MAX_JUMPS = 160
#: Rows ranked together inside a shard, about.
SLOT_BLOCK_ROWS = 20_000


def _low16(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFF))


def _next_state(hi: Column, lo: Column) -> tuple[Column, Column]:
    """key * multiplier + 1 modulo 2**64, on halves below 2**32."""
    m0, m1, m2, m3 = (F.lit(x).cast("long") for x in _LIMBS)
    low = lo * m0 + F.shiftleft(_low16(lo * m1), 16) + F.lit(1)
    high = (
        F.shiftright(low, 32) + F.shiftright(lo * m1, 16) + lo * m2 + F.shiftleft(_low16(lo * m3), 16)
        + hi * m0 + F.shiftleft(_low16(hi * m1), 16)
    )
    mask = F.lit(0xFFFFFFFF)
    return high.bitwiseAND(mask), low.bitwiseAND(mask)


def jump_hash(key: Column, shards: int) -> Column:
    """The shard of a long ``key`` among ``shards``, as an int; null keys count as 0."""
    if shards < 1:
        raise ValueError("shards must be positive")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(
        F.shiftrightunsigned(key, 32).alias("hi"),
        key.bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo"),
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
    )

    def step(state: Column, _: Column) -> Column:
        hi, lo = _next_state(state["hi"], state["lo"])
        draw = F.shiftright(hi, 1) + F.lit(1)
        j = F.floor((state["j"] + F.lit(1)).cast("double") * (F.lit(2147483648.0) / draw.cast("double")))
        go = state["j"] < F.lit(shards)
        return F.struct(
            F.when(go, hi).otherwise(state["hi"]).alias("hi"),
            F.when(go, lo).otherwise(state["lo"]).alias("lo"),
            F.when(go, state["j"]).otherwise(state["b"]).alias("b"),
            F.when(go, j.cast("long")).otherwise(state["j"]).alias("j"),
        )

    end = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, MAX_JUMPS))), start, step)
    done = F.when(end["j"] >= F.lit(shards), end["b"])
    return F.coalesce(done, F.raise_error(F.lit("jump hash did not settle")).cast("long")).cast("int")


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, size, text_crc32, law, shard, slot, grown_shard.

    ``slot`` numbers a shard's rows from 0 without gaps. Ranks come from blocks
    of a shard (by a hash of the key, about SLOT_BLOCK_ROWS rows each) plus the
    number of rows in the blocks before, so no task holds a whole shard. The
    number of blocks follows the row count, which Parquet answers from footers.
    """
    body = text_or_empty(text)
    rows = docs.select(
        F.col(key).cast("long").alias(key),
        (F.octet_length(body).cast("long") + F.lit(1)).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        jump_hash(F.col(key), shards).alias("shard"),
        jump_hash(F.col(key), shards + 1).alias("grown_shard"),
    )
    blocks = max(1, docs.count() // (shards * SLOT_BLOCK_ROWS) + 1) * 4
    # equal keys spread too: the block also takes the row's content
    rows = number_within(rows, "shard", [key, "text_crc32", "size"], blocks, "slot")
    return rows.select(key, "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
