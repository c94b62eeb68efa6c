"""Quality classifier by importance resampling over hashed n-grams.

Two generative models of hashed n-gram features are counted: one of the target
text (documents labelled good), one of the raw text (all documents). A document's
log importance is the sum over its features of log target minus log raw
probability; Gumbel noise is added, and the k documents of highest sum are the
resampled corpus. Features are word unigrams and bigrams (a repeated word is one
feature of its own, whatever the word) and bigrams of token shapes.

Both models count distinct texts: the copies of a text count once, as target if
any of them is in the target sample, and the whole text is taken out of both when
one of its copies is scored. Else a clean text would be rejected for being common.
The target sample is bounded, at most TARGET_LIMIT labelled documents (those of
least hashed id); the raw model counts every text. Both are arrays of BUCKETS
numbers. k defaults to the number of documents whose log
importance is above FLOOR, over the whole table: a document is left out only if
its text is far likelier raw than target, and noise of unit scale decides near
the floor alone. The k-th key is found exactly by narrowing histograms.

Defined results: a null, empty or blank text has no features and log importance
0; a document labelled more than once is good only if every label is; repeated
rows have equal keys and are kept or left out together (so ties at the k-th key
may exceed k); without labels the models are equal and every document is kept;
an empty table gives no rows; extra columns are carried along.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle, slices

BUCKETS = 1 << 16
#: Labelled documents that the target model is fitted on, at most.
TARGET_LIMIT = 50_000
FLOOR = -3.0
#: Pseudo-count of a bucket in both models: words seen in a few documents say nothing yet.
PRIOR = 200.0
SEED = 17
#: Bytes of text whose features are held at a time, about.
RUN_BYTES = 1 << 19
#: Digests of repeated or target texts up to this many are broadcast; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Parts that the copies of one text are dealt over in that shuffle.
COPY_PARTS = 64

_TOKEN = re.compile(r"\w+|[^\w\s]+|\n+")
_REPEAT = np.uint64(7 << 45)


class _Tokens(dict):
    """Token to hash of its lower-cased form (low half) and of its shape (high half); emptied when large."""

    def __missing__(self, token: str) -> int:
        first = token[0]
        if first == "\n":
            shape = 1
        elif not (first.isalnum() or first == "_"):
            shape = 16 + zlib.crc32(token[:3].encode()) % 4096
        elif token.isdigit():
            shape = 2
        elif token.islower():
            shape = 3
        elif token.isupper():
            shape = 4 if len(token) > 1 else 5
        else:
            shape = 6 if token.istitle() else 7
        if len(self) > 100_000:
            self.clear()
        value = self[token] = zlib.crc32(token.lower().encode()) | shape << 32
        return value


_TOKENS = _Tokens()


def _bucket(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(48)).astype(np.int64)


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of ``texts``, and for each feature the index of its text."""
    found = [_TOKEN.findall(t) for t in texts]
    sizes = np.array([len(f) for f in found], np.int64)
    n = int(sizes.sum())
    both = np.fromiter((_TOKENS[t] for f in found for t in f), np.uint64, n)
    owner = np.repeat(np.arange(len(texts)), sizes)
    word, shape = both & np.uint64(0xFFFFFFFF), both >> np.uint64(32)
    within = owner[1:] == owner[:-1]
    pair = word[:-1] * np.uint64(31) + word[1:] + np.uint64(1 << 40)
    pair[word[:-1] == word[1:]] = _REPEAT
    shapes = shape[:-1] * np.uint64(8192) + shape[1:] + np.uint64(1 << 50)
    buckets = np.concatenate([_bucket(word), _bucket(pair[within]), _bucket(shapes[within])])
    return buckets, np.concatenate([owner, owner[1:][within], owner[1:][within]])


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


@dataclass
class Models:
    """Feature counts of all distinct texts and of those in the target sample, and the digests of the latter."""

    raw: np.ndarray
    target: np.ndarray
    sample: DataFrame

    def log_weights(self, texts: list[str], flags: np.ndarray) -> np.ndarray:
        """The log importance of each text; ``flags``: it is in the target sample.

        A text's own counts are first taken out of both models, else documents of
        the sample would seem likelier and all others less likely than they are.
        """
        buckets, owner = features(texts)
        both, own = np.unique(owner * BUCKETS + buckets, return_counts=True)
        owner, buckets = both // BUCKETS, both % BUCKETS
        share = self.target.sum() / max(self.raw.sum(), 1)
        expected = (self.raw[buckets] - own) * share + PRIOR
        seen = self.target[buckets] - own * flags[owner] + PRIOR
        return np.bincount(owner, weights=own * np.log(seen / expected), minlength=len(texts))


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.col(text)))


def _shared(docs: DataFrame, sample: DataFrame, key: str, text: str) -> DataFrame:
    """_digest, _copies and _target of the texts that have copies or are in the target ``sample``."""
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).cast("long").alias("_id"), _digest(text).alias("_digest"))
    rows = rows.join(F.broadcast(sample), "_id", "left")
    found = rows.groupBy("_digest").agg(F.count("*").alias("_copies"), F.coalesce(F.max("_target"), F.lit(False)).alias("_target"))
    return settle(found.where("_copies > 1 OR _target"), "shared")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", limit: int = TARGET_LIMIT) -> Models:
    """Count both models over ``docs``."""
    good = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("_id")).agg(F.min("quality").alias("_q")).where("_q = 1")
    sample = good.orderBy(F.xxhash64("_id", F.lit(SEED)), "_id").limit(limit).select("_id", F.lit(True).alias("_target"))
    shared = _shared(docs, settle(sample, "target"), key, text)
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"), _digest(text).alias("_digest"))
    if shared.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(shared), "_digest", "left")
    else:
        parts = shared.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(COPY_PARTS - 1))))
        rows = rows.withColumn("_part", F.pmod(F.xxhash64("_id"), F.lit(COPY_PARTS)).cast("int")).join(parts, ["_digest", "_part"], "left")
    rows = rows.select("_text", F.coalesce("_target", F.lit(False)).alias("_target"), F.coalesce("_copies", F.lit(1)).alias("_copies"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for batch in (s for b in batches for s in slices(b, 0, RUN_BYTES)):
            flags, weights = batch.column(1).to_numpy(zero_copy_only=False), 1 / batch.column(2).to_numpy()
            buckets, owner = features(_texts(batch.column(0)))
            raw += np.bincount(buckets, weights=weights[owner], minlength=BUCKETS)
            target += np.bincount(buckets, weights=(weights * flags)[owner], minlength=BUCKETS)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"])

    counts = rows.mapInArrow(count, "bucket long, raw double, target double").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.collect():  # BUCKETS rows at most
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    # n copies add n parts of 1/n: counts of distinct texts are whole numbers again, whatever the order of the sum
    return Models(np.rint(raw), np.rint(target), shared.where("_target").select("_digest", "_target"))


def _gumbel(key: str, text: str) -> Column:
    """Standard Gumbel noise, a function of the row."""
    u = (F.xxhash64(F.col(key), F.col(text), F.lit(SEED)).bitwiseAND(F.lit(2**52 - 1)) + F.lit(0.5)) / F.lit(float(2**52))
    return -F.log(-F.log(u))


def score(docs: DataFrame, models: Models, key: str = "doc_id", text: str = "text", carry: bool = False) -> DataFrame:
    """``row`` (a struct of the key, with ``carry`` of every column of ``docs``), ``_log_weight`` and ``_key`` (with noise)."""
    # the row travels as one struct, so no name of its columns can clash
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]) if carry else F.struct(F.col(key))
    rows = docs.select(row.alias("row"), F.col(text).alias("_text"), _gumbel(key, text).alias("_noise"), _digest(text).alias("_digest"))
    rows = rows.join(F.broadcast(models.sample), "_digest", "left").select("row", "_text", "_noise", F.coalesce("_target", F.lit(False)).alias("_target"))
    fields = [rows.schema["row"], T.StructField("_log_weight", T.DoubleType()), T.StructField("_key", T.DoubleType())]
    counts = Models(models.raw, models.target, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in slices(b, 1, RUN_BYTES)):
            weight = counts.log_weights(_texts(batch.column(1)), batch.column(3).to_numpy(zero_copy_only=False))
            noisy = weight + batch.column(2).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(weight), pa.array(noisy)], names=[f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields))


def kth_largest(scores: DataFrame, column: str, k: int, bins: int = 4096) -> float | None:
    """The exact k-th largest value of a double column (None if k is 0; the least if k exceeds the rows), by histograms."""
    low, high, n = scores.agg(F.min(column), F.max(column), F.count(column)).first()
    if k <= 0 or not n:
        return None
    k = min(k, n)
    while low < high:
        rows = scores.where(F.col(column).between(low, high))
        width = (high - low) / bins
        if low + width == low:  # too few doubles between them for bins: every value is its own
            found = rows.groupBy(F.col(column).alias("high")).agg(F.count("*").alias("n"), F.min(column).alias("low"))
        else:
            at = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
            found = rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high"))
        for r in sorted(found.collect(), key=lambda r: -r["high"]):  # about `bins` rows at most
            if k <= r["n"]:
                low, high = r["low"], r["high"]
                break
            k -= r["n"]
    return high


def threshold(scores: DataFrame, k: int | None = None, floor: float = FLOOR) -> float:
    """A number between the least key of the sample of size ``k`` and the next smaller one.

    Midway, so that a text scored again on another machine, whose logarithm may round
    otherwise, falls on the same side.
    """
    if k is None:
        k = scores.where(F.col("_log_weight") > floor).count()
    least = kth_largest(scores, "_key", k)
    if least is None:
        return float("inf")
    below = scores.where(F.col("_key") < least).agg(F.max("_key")).first()[0]
    return least - 1.0 if below is None else (least + below) / 2 if (least + below) / 2 > below else least


def resample(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", k: int | None = None) -> DataFrame:
    """The kept documents: key, log_weight and key with noise."""
    scores = settle(score(docs, fit(docs, labels, key, text), key, text), "scores")
    return scores.where(F.col("_key") >= threshold(scores, k)).select(f"row.{key}", F.col("_log_weight").alias("log_weight"), F.col("_key").alias("noisy_log_weight"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", k: int | None = None) -> DataFrame:
    """``docs`` without the rejected rows, columns as they were. Texts are scored again rather than joined: nothing moves."""
    models = fit(docs, labels, key, text)
    least = threshold(settle(score(docs, models, key, text), "scores"), k)
    return score(docs, models, key, text, carry=True).where(F.col("_key") >= least).select("row.*")
