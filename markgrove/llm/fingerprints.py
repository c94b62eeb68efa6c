"""Document fingerprints: threshold-scaled sketches of word shingles, in SQL expressions only.

A sketch keeps every shingle hash below 1/SCALE of the hash range. Which hashes
stay does not depend on the document, so sketches merge by union, and the
containment of a short text in a very long one can be estimated as well as their
resemblance. Beside them a sketch has ``least``, the smallest hash of the text,
whether below the threshold or not. It merges by the minimum and takes no part in
an estimate while one of the two sketches has a hash below the threshold; where
neither has, it tells equal short texts from different ones.

Words are split at runs of whitespace characters space, \\t..\\r and lower-cased;
a shingle is five words, a text with one to four words is one shingle. A null,
empty or blank text has the empty sketch (its ``least`` is null); two empty sketches
are alike (1.0), an empty and a non-empty one are not (0.0). Equal texts have equal
fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import once, settle, text_or_empty

SHINGLE_WORDS = 5
SCALE = 4
#: Ids of a block are consecutive integers, so that no block holds more distinct ids than this.
BLOCK_BITS = 8
#: Block heads up to this many are broadcast (16 bytes each); beyond it they are joined by a shuffle.
BROADCAST_ROWS = 500_000
_LOWEST = -(2**63)


def sketch(text: Column, words: int = SHINGLE_WORDS, scale: int = SCALE) -> Column:
    """The sketch of ``text`` as struct<hashes: array<bigint> (sorted, distinct), least: bigint>."""
    split = F.filter(F.split(F.lower(text), r"[\x20\t-\r]+"), lambda w: w != "")
    limit = F.lit(_LOWEST + 2**64 // scale)

    def shingles(tokens: Column) -> Column:
        last = F.size(tokens) - F.lit(words)
        one = F.array(F.xxhash64(F.concat_ws(" ", tokens)))
        many = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(tokens, i + F.lit(k)) for k in range(words)]))
        return F.when(F.size(tokens) == 0, F.array().cast("array<bigint>")).when(last < 0, one).otherwise(many)

    def keep(hashes: Column) -> Column:
        return F.struct(F.array_sort(F.array_distinct(F.filter(hashes, lambda h: h < limit))).alias("hashes"), F.array_min(hashes).alias("least"))

    return once(once(split, shingles), keep)


def as_text(a: Column) -> Column:
    """A sketch as a string: sixteen hex digits a hash, in order; of a text with none ``<`` and those of the least."""
    digits = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    few = F.when(a["least"].isNull(), F.lit("")).otherwise(F.concat(F.lit("<"), digits(a["least"])))
    return F.when(F.size(a["hashes"]) == 0, few).otherwise(F.array_join(F.transform(a["hashes"], digits), ""))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of the texts behind two sketches."""
    common = F.size(F.array_intersect(a["hashes"], b["hashes"]))
    total = F.size(a["hashes"]) + F.size(b["hashes"]) - common
    return F.when(total == 0, a["least"].eqNullSafe(b["least"]).cast("double")).otherwise(common / F.greatest(total, F.lit(1)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the first text's shingles that the second has; null if no hash of the first allows an estimate."""
    n = F.size(a["hashes"])
    estimate = F.size(F.array_intersect(a["hashes"], b["hashes"])) / F.greatest(n, F.lit(1))
    few = F.when(a["least"].isNull() | (a["least"] == b["least"]), F.lit(1.0)).when(b["least"].isNull() | (a["least"] < b["least"]), F.lit(0.0))
    return F.when(n > 0, estimate).otherwise(few)


def merge(a: Column, b: Column) -> Column:
    """The sketch of both texts' shingles taken together."""
    return F.struct(F.array_sort(F.array_union(a["hashes"], b["hashes"])).alias("hashes"), F.least(a["least"], b["least"]).alias("least"))


def next_ids(ids: DataFrame, key: str) -> DataFrame:
    """For the first id of each block: the block before it. Columns ``_block``, ``_first`` (smallest id), ``_next_first``.

    The successor of a block is found level by level on ever coarser blocks, so
    each window ranks a bounded number of rows however ids are spread.
    """
    blocks = ids.groupBy(F.shiftright(key, BLOCK_BITS).alias("_block")).agg(F.min(key).alias("_first"))
    levels = [blocks]
    for _ in range(3):
        up = levels[-1].groupBy(F.shiftright("_block", 16).alias("_block")).agg(F.min("_first").alias("_first"))
        levels.append(up)
    above = levels[-1].select("_block", "_first", F.lead("_first").over(Window.orderBy("_block")).alias("_next_first"))
    for level in reversed(levels[:-1]):
        inside = Window.partitionBy("_up").orderBy("_block")
        here = level.withColumn("_up", F.shiftright("_block", 16))
        here = here.withColumn("_lead", F.lead("_first").over(inside))
        above = here.join(above.select(F.col("_block").alias("_up"), F.col("_next_first").alias("_after")), "_up").select(
            "_block", "_first", F.coalesce("_lead", "_after").alias("_next_first")
        )
    return above


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text; columns as in ``op4``, plus containment_in_edited.

    The edited text is the text with its last floor(n/2) code points replaced by
    the first as many of the next document by ascending key (the first one after
    the last). Texts move once, to the block of their id; only the first text of
    each block moves a second time, to the end of the block before. (Where ids lie so
    far apart that most blocks have one document, most texts move twice.) Sketches
    are made where the texts meet and never move.

    Defined results: null keys order before all others, as the lowest long;
    repeated keys follow each other by text; a lone document is its own next.
    """
    body = text_or_empty(text)
    own_id = F.coalesce(F.col(key).cast("long"), F.lit(_LOWEST))
    ids = docs.select(own_id.alias("_id"))
    lowest = ids.agg(F.min("_id")).first()[0]
    blocks = settle(next_ids(ids, "_id"), "blocks")
    # the head of each block also goes, as a marked row, to the end of the block before
    ends = blocks.select(F.col("_block").alias("_end"), F.coalesce("_next_first", F.lit(lowest).cast("long")).alias("_hid"))
    if blocks.count() <= BROADCAST_ROWS:
        ends = F.broadcast(ends)
    heads = docs.select(own_id.alias("_hid"), body.alias("_text")).join(ends, "_hid")
    heads = heads.groupBy("_end").agg(F.min("_text").alias("_text"))
    rows = docs.select(
        own_id.alias("_id"), F.col(key).cast("long").alias(key), body.alias("_text"),
        F.shiftright(own_id, BLOCK_BITS).alias("_block"), F.lit(False).alias("_head"),
    )
    heads = heads.select(F.lit(0).cast("long").alias("_id"), F.lit(None).cast("long").alias(key), "_text", F.col("_end").alias("_block"), F.lit(True).alias("_head"))
    rows = rows.unionByName(heads)
    order = Window.partitionBy("_block").orderBy("_head", "_id", "_text")
    rows = rows.withColumn("_n", F.lead("_text").over(order)).where(~F.col("_head"))
    size = F.length("_text")
    half = F.floor(size / 2).cast("int")
    rows = rows.withColumn("_edited", F.concat(F.substring(F.col("_text"), F.lit(1), size - half), F.substring(F.col("_n"), F.lit(1), half)))
    rows = rows.withColumns({"_sketch": sketch(F.col("_text")), "_es": sketch(F.col("_edited")), "_ns": sketch(F.col("_n"))})
    return rows.select(
        key,
        size.cast("long").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        as_text(F.col("_sketch")).alias("fingerprint"),
        as_text(F.col("_es")).alias("edited_fingerprint"),
        resemblance(F.col("_sketch"), F.col("_es")).alias("near_edited"),
        resemblance(F.col("_sketch"), F.col("_ns")).alias("near_next"),
        containment(F.col("_sketch"), F.col("_es")).alias("containment_in_edited"),
    )
