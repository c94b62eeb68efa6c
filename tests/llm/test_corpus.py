"""Near-dedup, neighbours, quality, archives and the pipeline against brute force."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from test_tokens import check_packing

import corpus_pipeline
from markgrove.llm import ann, common, near_dedup, quality, warc
from markgrove.llm.components import components
from markgrove.llm.shingles import shingle_sets

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute_components(docs, k, percent):
    """id -> least id reachable, comparing all pairs; docs are (id, text) with distinct ids."""
    sets = {i: shingles(t, k) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}, sets


def corpus(seed=5):
    """Copies, near copies at many distances, drifting chains, shared passages, and unrelated texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    text = lambda n: [word() for _ in range(n)]
    out, passage = [], text(60)
    for size in (1, 3, 12, 40):
        base = text(rng.randrange(30, 150))
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(len(copy))] = word()
            out.append(copy)
    chain = text(120)
    for _ in range(15):
        chain = list(chain)
        chain[rng.randrange(len(chain))] = word()
        out.append(list(chain))
    out += [text(20) + passage + text(rng.randrange(5, 40)) for _ in range(30)]
    out += [text(rng.randrange(1, 60)) for _ in range(30)] + [out[0]] * 20
    rng.shuffle(out)
    return [(100 + i * 3, " ".join(w).title() if i % 4 == 0 else "  ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize(("words", "percent", "tables", "chunk", "star"), [(3, 85, 8, 200_000, 1000), (5, 80, 10, 300, 3)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, words, percent, tables, chunk, star):
    monkeypatch.setattr(near_dedup, "CHUNK_SHINGLES", chunk)
    monkeypatch.setattr(near_dedup, "STAR_ROWS", star)
    monkeypatch.setattr(common, "HOT_ROWS", star)  # with 3 most groups are hot
    docs = corpus()
    rows = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), words, percent, tables=tables).collect()
    want, sets = brute_components(docs, words, percent)
    assert {r.doc_id: r.component_id for r in rows} == want
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.doc_id == r.component_id) for r in rows)
    assert max(Counter(want.values()).values()) > 20 and len(set(want.values())) > 30


def test_near_duplicates_of_odd_rows(odd, none):
    rows = near_dedup.near_duplicates(odd, 3, 85).collect()
    assert len(rows) == odd.count()
    got = defaultdict(set)
    for r in rows:
        got[r.doc_id].add((r.n_shingles, r.component_id, r.kept))
    assert got[0] == {(0, 0, True)} and got[1] == {(0, 1, True)} and got[2] == {(0, 2, True)}
    assert got[6] == {(6, 6, True)} and got[7] == {(6, 6, False)} and got[None] == {(3, None, True)} and got[9] == {(1, 9, True)}
    assert near_dedup.near_duplicates(none).count() == 0
    kept = near_dedup.keep_one(odd, 3, 85)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in odd.collect() if r.doc_id != 7)


def test_texts_with_a_common_boilerplate_leave_at_the_prefix(spark):
    """Similarity of about 0.3 fills buckets with texts that are no copies; none of them meets another in a block."""
    rng = random.Random(2)
    text = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    passage = text(60)
    docs = [(i, " ".join(text(35) + passage + text(30))) for i in range(600)]
    near = docs[7][1].split()
    near[3] = "changed"
    docs.append((1000, " ".join(near)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want, _ = brute_components(docs, 3, 85)
    assert {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, 3, 85).collect()} == want and want[1000] == 7
    sets = near_dedup._sets(df, spark.createDataFrame([(i, near_dedup._set_key(s)) for (i, _), s in zip(docs, shingle_sets(pa.array([t for _, t in docs]), 3))], "class long, set_key binary"), 3, "doc_id", "text")
    opened = sets.select("class", F.col("class").alias("joined"), "set")
    assert {r.node for r in near_dedup._prefix_groups(opened, 85).collect()} == {7, 1000}


def test_rows_that_share_an_id_are_kept_by_their_text(spark):
    a, b = "one text that both of these rows have", "quite another text that nothing else is like"
    rows = [(1, a, 0), (7, a, 1), (7, b, 2), (9, b + " x y z", 3), (9, b + " x y z", 4), (None, a, 5), (None, a, 6)]
    kept = near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, n int"), 3, 85).collect()
    assert sorted(r.n for r in kept if r.n not in (3, 4)) == [0, 2, 5, 6] and len(kept) == 5


def test_tensoring_rarely_misses():
    assert near_dedup.miss_probability(0.85) < 0.001 and near_dedup.miss_probability(0.8, 3, 10) < 0.002
    rng = np.random.default_rng(0)
    hits = 0
    for _ in range(200):
        common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (170, 15, 15))
        keys = near_dedup.half_keys([np.unique(np.concatenate([common, a])), np.unique(np.concatenate([common, b]))], 3, 8)
        same = keys[0] == keys[1]
        hits += same[:8].any() and same[8:].any()
    assert hits >= 198


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60) if i % 20 != 19] + [(1000, 1000 + i) for i in range(1, 200)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(300)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long"), "a", "b", "test").collect()
    assert {r.node: r.component for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)


def nearest_by_force(rows, k):
    x = {i: np.array(v, np.float64) for i, v in rows}
    out = {}
    for q in sorted(i for i in x if i % 20 == 0):
        scored = sorted((-(x[q] * v).sum(), i) for i, v in x.items() if i != q)
        out[q] = [i for _, i in scored[:k]]
    return out


def test_neighbours_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK_VECTORS", 100)
    monkeypatch.setattr(ann, "CHUNK_QUERIES", 10)
    rng = np.random.default_rng(2)
    points = rng.normal(size=(800, 16)).astype(np.float32)
    points[:300] = points[0] + 0.1 * rng.normal(size=(300, 16))
    points *= rng.uniform(0.5, 2.0, (800, 1)).astype(np.float32)
    points[400:500] = points[400]  # many equal vectors: ties go to the smaller id
    rows = [(i, [float(c) for c in p]) for i, p in enumerate(points)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    want = nearest_by_force(rows, 20)
    got = defaultdict(list)
    for r in ann.nearest(docs, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        assert r.score == pytest.approx(float((points[r.query_id].astype(float) * points[r.vec_id].astype(float)).sum()), abs=1e-9)
        got[r.query_id].append(r.vec_id)
        assert r.rank == len(got[r.query_id]) and r.vec_id != r.query_id
    assert got.keys() == want.keys() and all(len(v) == len(set(v)) == 20 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * sum(map(len, want.values()))


def test_settings_follow_the_data():
    """Clusters are found with few visits, and with a smaller share of them as the table grows."""
    rng = np.random.default_rng(5)
    shares = []
    for n in (2000, 16000):
        centres = rng.normal(size=(n // 100, 32))
        points = centres[rng.integers(0, len(centres), n)] + 0.3 * rng.normal(size=(n, 32))
        q, own = points[:1000:20], np.arange(0, 1000, 20)
        score = q @ points.T
        score[np.arange(len(q)), own] = -np.inf
        lifted = ann.lift(points, np.linalg.norm(points, axis=1).max())
        setting = ann.choose(q, [lifted[i] for i in np.argsort(-score, axis=1)[:, :20]], lifted[::2], n)
        assert setting.recall >= ann.TARGET and setting == ann.choose(q, [lifted[i] for i in np.argsort(-score, axis=1)[:, :20]], lifted[::2], n)
        codes = [set(c.tolist()) for c in setting.probed(q, 0)]
        ranks = setting.ranks(q, lifted, 0)
        bucket = ann._code(setting.cells(lifted, 0)[0])
        assert all((r < setting.probes).tolist() == [b in c for b in bucket.tolist()] for r, c in zip(ranks, codes, strict=True))
        shares.append(setting.visited)
    assert shares[1] < 0.7 * shares[0] < 0.3


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, None]), (6, []), (7, [1.0, 2.0, 3.0]), (20, [2.0, 0.0]), (21, [2.0, 0.0]), (None, [1.0, 1.0]), (22, [0.5, 0.5]), (22, [0.5, 0.5])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(docs, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 20, 2.0), (0, 2, 21, 2.0), (0, 3, 22, 0.5), (20, 1, 21, 4.0), (20, 2, 0, 2.0), (20, 3, 22, 1.0)]
    assert ann.nearest(docs.where("false"), F.lit(True)).count() == 0
    assert ann.nearest(docs.where("vec_id = 2"), F.lit(True)).count() == 0


@pytest.mark.parametrize("n", [2, 10, 20, 25, 40])
def test_neighbours_of_tiny_tables_are_whole(spark, n):
    points = np.random.default_rng(n).normal(size=(n, 64))
    rows = [(i, [float(c) for c in p / np.linalg.norm(p)]) for i, p in enumerate(points)]
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    want = nearest_by_force(rows, 20)
    assert got.keys() == want.keys()
    for q, found in got.items():
        assert len(found) == len(set(found)) == min(20, n - 1)
        assert n > 21 or found == want[q]


@pytest.mark.parametrize(("chunk", "asking"), [(20_000, 4_000), (300, 2)])
def test_neighbours_of_queries_opposite_a_cluster(spark, monkeypatch, chunk, asking):
    monkeypatch.setattr(ann, "CHUNK_VECTORS", chunk)
    monkeypatch.setattr(ann, "CHUNK_QUERIES", asking)
    rng = np.random.default_rng(3)
    centre = rng.normal(size=64)
    points = centre / np.linalg.norm(centre) + 0.02 * rng.normal(size=(2000, 64))
    points[:100:20] *= -1  # five queries point the other way
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    rows = [(i, [float(c) for c in p]) for i, p in enumerate(points)]
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    want = nearest_by_force(rows, 20)
    assert all(len(got[q]) == 20 for q in want)
    assert all(got[q] == want[q] for q in range(0, 100, 20))


def good_and_bad(spark, n=400, seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8)))
    docs, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        words = [word() for _ in range(rng.randrange(20, 120))]
        docs.append((i, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words) + "."))
        if rng.random() < 0.4:
            labels.append((i, 0 if bad else 1))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), {i for i in range(n) if i % 6 == 0}


def test_classifier_drops_bad_and_keeps_good_beyond_the_labels(spark):
    docs, labels, bad = good_and_bad(spark)
    kept = {r.doc_id for r in quality.resample(docs, labels).collect()}
    assert not kept & bad and len(kept) >= 0.99 * (400 - len(bad))
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == kept
    assert quality.resample(docs, labels, k=50).count() == 50


def buckets_by_force(text):
    """The features of a text one by one, in plain integers."""
    mask = 2**64 - 1

    def bucket(x):
        x = (x + 1) * 0x9E3779B97F4A7C15 & mask
        x ^= x >> 29
        return (x * 0xBF58476D1CE4E5B9 & mask) >> 48

    tokens = re.findall(r"\w+|[^\w\s]+|\n+", text)

    def shape(t):
        if t[0] == "\n":
            return 1
        if not (t[0].isalnum() or t[0] == "_"):
            return 16 + zlib.crc32(t[:3].encode()) % 4096
        if t.isdigit():
            return 2
        if t.islower():
            return 3
        if t.isupper():
            return 4 if len(t) > 1 else 5
        return 6 if t.istitle() else 7

    words = [zlib.crc32(t.lower().encode()) for t in tokens]
    shapes = [shape(t) for t in tokens]
    found = [bucket(w) for w in words]
    for (a, b), (x, y) in zip(zip(words, words[1:]), zip(shapes, shapes[1:])):
        found.append(bucket(7 << 45 if a == b else (a * 31 + b + (1 << 40)) & mask))
        found.append(bucket((x * 8192 + y + (1 << 50)) & mask))
    return Counter(found)


def test_log_weights_and_gumbel_selection_equal_brute_force(spark):
    docs, labels, _ = good_and_bad(spark, n=150, seed=11)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(500 + i, rows[i % 3][1]) for i in range(40)] + [(700, None), (701, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    texts = {t for _, t in rows if t is not None}
    target = {t for i, t in rows if i in good and t is not None}
    raw, aim = Counter(), Counter()
    for t in texts:
        raw += buckets_by_force(t)
    for t in target:
        aim += buckets_by_force(t)
    share = sum(aim.values()) / sum(raw.values())
    want = {}
    for i, t in rows:
        own = buckets_by_force(t or "")
        weight = sum(n * math.log((aim[b] - n * (t in target) + quality.PRIOR) / ((raw[b] - n) * share + quality.PRIOR)) for b, n in own.items())
        h = xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest()
        h = h if t is None else xxhash.xxh64(t.encode(), seed=h).intdigest()
        h = xxhash.xxh64(struct.pack("<i", quality.SEED), seed=h).intdigest()
        noise = -math.log(-math.log((h % 2**52 + 0.5) / 2**52))
        want[i] = weight, weight + noise
    k = sum(w > quality.FLOOR for w, _ in want.values())
    for size in (None, 25):
        top = sorted(want, key=lambda i: -want[i][1])[: size or k]
        got = {r.doc_id: r for r in quality.resample(docs, labels, k=size).collect()}
        assert set(got) == set(top)
        assert all(abs(got[i].log_weight - want[i][0]) < 1e-8 and abs(got[i].noisy_log_weight - want[i][1]) < 1e-8 for i in top)
        assert {r.doc_id for r in quality.keep_good(docs, labels, k=size).collect()} == set(top)


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_classifier_keeps_clean_texts_with_many_copies(spark, monkeypatch, broadcast):
    monkeypatch.setattr(quality, "BROADCAST_ROWS", broadcast)
    docs, labels, bad = good_and_bad(spark)
    labelled = {r.doc_id for r in labels.collect()}
    once = quality.resample(docs, labels).collect()
    want = {r.doc_id: r.log_weight for r in once}
    free = next(i for i in range(400) if i not in bad and i not in labelled)
    marked = next(i for i in range(400) if i not in bad and i in labelled)
    for original in (free, marked):  # the copies have no labels and are a third of all rows
        copies = docs.where(F.col("doc_id") == original).crossJoin(spark.range(1000, 1200)).select(F.col("id").alias("doc_id"), "text")
        got = {r.doc_id: r.log_weight for r in quality.resample(docs.unionByName(copies).repartition(5), labels).collect()}
        assert {original, *range(1000, 1200)} <= got.keys() and not got.keys() & bad
        assert {got[i] for i in range(1000, 1200)} == {got[original]} == {want[original]}
        assert sum(got.get(i) == w for i, w in want.items()) >= 0.99 * len(want)


def test_classifier_on_odd_rows(odd, none, spark):
    labels = spark.createDataFrame([(3, 1), (3, 1), (4, 0), (4, 1), (None, 1), (5, None)], "doc_id long, quality int")
    out = quality.keep_good(odd, labels)
    assert out.columns == odd.columns and {0, 1, 2} <= {r.doc_id for r in out.collect()}
    assert quality.keep_good(odd, labels.where("false")).count() == odd.count()
    assert quality.keep_good(none, labels).count() == 0 and quality.resample(none, labels).count() == 0


def test_kth_largest(spark):
    rng = random.Random(4)
    values = [rng.choice([rng.gauss(0, 1), 5.0, rng.gauss(0, 1e-9), -1e6]) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").cache()
    ranked = sorted(values, reverse=True)
    for k in (1, 2, 700, 1500, 3000):
        assert quality.kth_largest(df, "v", k, bins=16) == ranked[k - 1]
    assert quality.kth_largest(df, "v", 0) is None


@pytest.mark.parametrize("hot_rows", [1000, 2])
def test_archives_round_trip(spark, tmp_path, monkeypatch, hot_rows):
    monkeypatch.setattr(warc, "HOT_ROWS", hot_rows)
    rows = [(i, f"http://x/é {i % 7}\n", "A" * 1500 if i % 3 == 0 else "b" * 999 if i % 5 == 0 else f"<p>é{i % 50}</p>" * 200, i) for i in range(900)]
    rows += [(6001, None, None, 0), (None, None, "A" * 1500, 0), (5, "u", "zz", 0), (3, "u", "A" * 1500, 0), (898, "u", "c" * 70_000, 1), (898, "u", "c" * 70_000, 1)]
    uri = f"file://{tmp_path}/warc"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, _id int")
    manifest = warc.write_warc(pages, uri, shard_bytes=200_000, roll_bytes=3_000).collect()
    assert sum(m.records for m in manifest) == len(rows) and len(manifest) > 5
    again = warc.write_warc(pages.repartition(7), uri, shard_bytes=200_000, roll_bytes=3_000).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, manifest))  # names and sizes depend on the records only
    largest = {}
    for i, _, h, _ in rows:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    want = Counter()
    for i, _, h, _ in rows:
        body = (h or "").encode()
        revisit = len(body) >= 1000 and i != largest[h]
        want[(i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", largest[h] if revisit else None)] += 1
    got = warc.read_warc(spark, uri, payload=True).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(r.payload is None if r.record_type == "revisit" else hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got)


def test_archives_of_no_pages_and_damage(spark, tmp_path):
    uri = f"file://{tmp_path}/none"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_warc(empty, uri).count() == 0 and warc.read_warc(spark, uri).count() == 0
    record = warc.make_record(1, "u", b"abc", None)
    assert warc.parse_record(record)["payload"] == b"abc"
    with pytest.raises(ValueError):
        warc.parse_record(record.replace(b"abc", b"abd"))


def test_pipeline_stages_on_odd_rows(odd, none, spark, tmp_path):
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == odd.columns, name
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs, labels, bad = good_and_bad(spark, 120)
    near = docs.where("doc_id % 10 = 1").selectExpr("doc_id + 1000 AS doc_id", "concat(text, ' more')  AS text")
    secret = spark.createDataFrame([(2000, "here token = 'abcdef123456' and more words follow to the end of it all")], "doc_id long, text string")
    whole = docs.unionByName(near).unionByName(secret).selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "CAST(length(text) AS LONG) AS n_chars")
    whole.write.parquet(f"{tmp_path}/documents.parquet")
    labels.withColumn("toxic", F.lit(0)).write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {r.doc_id: r.text for r in whole.collect() if r.doc_id not in bad}
    component, _ = brute_components(sorted(texts.items()), 5, 80)
    kept = [(i, t.replace("token = 'abcdef123456", "[secret]")) for i, t in texts.items() if component[i] == i]
    assert {i for i, _ in kept} & {1001, 1011} == set() and {r.doc_id for r in rows} == {i for i, _ in kept}
    check_packing(rows, kept, 2048)
