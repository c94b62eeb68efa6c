"""The registered queries of this subpackage: one ``opN_<name>`` an operator, each over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scan import spread
from . import ann, bpe, fingerprints, near_dedup, packing, quality, secrets, sharding, token_counts, warc
from .common import fresh_path, table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(spread(docs), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op2_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=16)


def op3_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, F.col("vec_id") % 20 == 0, k=20)


def op4_scaled_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprints.fingerprint_documents(docs).drop("containment_in_edited")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack_documents(spread(docs), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    decoded = bpe.bpe_decode(bpe.bpe_encode(spread(docs), path, offsets="offsets"), path, offsets="offsets")
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri = fresh_path(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), uri)
    return warc.read_warc(spark, uri).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.resample(spread(docs), table(spark, sf_dir, "labels"))


def op9_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(spread(docs), words=3, percent=85)


QUERIES = {
    f.__name__: f
    for f in (op1_token_counts, op2_jump_sharding, op3_multiprobe_neighbours, op4_scaled_fingerprints, op5_best_fit_packing, op6_bpe_round_trip, op7_warc_round_trip, op8_importance_resampling, op9_entropy_secrets, op10_tensored_minhash)
}

ORACLE_SQL: dict[str, str] = {
    "op7_warc_round_trip": """
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
        FROM (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
                     max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last
              FROM pages)
    """,
    "op10_tensored_minhash": r"""
        WITH RECURSIVE words AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        places AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, least(len(w), 1) + 1))) AS i FROM words),
        shingles AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 2], ' ')) AS s FROM places),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        links AS (
          SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
          JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (min(x.n) + min(y.n) - count(*))),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(reach.b) AS component_id, d.doc_id = min(reach.b) AS kept
        FROM documents d LEFT JOIN sizes ON sizes.doc_id = d.doc_id JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, n
    """,
}
