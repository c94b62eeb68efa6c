"""Token counts, byte-level BPE and packing against the public libraries."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from markgrove.llm import bpe, packing, token_counts

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECES = ["ab", "'s", "'ll", "'", " '", "S", " ", "  ", "\n", "1²", "٣", "!?…", "éÉ", "ßİΣσς", "ñ", "世界", "🌍", "́", "\x1c", "\u0085", "​", "ǅK", "ﬁ", "<|endoftext|>", "<|startoftext|>", "가", "H̱"]
text = st.lists(st.sampled_from(PIECES), max_size=30).map("".join)


@pytest.fixture(scope="module")
def tools():
    merger = bpe.PairMerger(RANKS)
    reference = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merger.ranks, special_tokens={})
    return merger, reference, Tokenizer.from_file(WORDS), token_counts.PieceCounter(WORDS), Tokenizer.from_file(BYTES), bpe.PairMerger(BYTES)


@settings(max_examples=400, deadline=None)
@given(text)
def test_all_three_agree_with_the_libraries(tools, t):
    merger, reference, words, counter, byte_level, own = tools
    assert bpe.pre_tokenise([t])[0][0] == regex.findall(public_tokenizers.PATTERN, t)
    packed = merger.encode([t])[0]
    assert np.frombuffer(packed, "<u4").tolist() == reference.encode_ordinary(t)
    assert merger.decode(packed) == t.encode()
    assert counter.count(t) == len(words.encode(t, add_special_tokens=False).ids)
    ids = own.encode(["x", t])[1]
    assert np.frombuffer(ids, "<u4").tolist() == byte_level.encode(t, add_special_tokens=False).ids
    assert own.decode(ids) == t.encode()


def test_offsets_decode_and_refuse_what_is_spoilt(tools):
    merger = tools[0]
    t = "Éa 世界 \U0001f30d don't  stop\n"
    tokens, chars = bpe.pre_tokenise([t])[0]
    parts = merger.packed(tokens)
    ids = np.cumsum([0, *map(len, parts)])[:-1] // 4
    packed = b"".join(parts)
    assert bpe.checked_bytes(merger, packed, chars, ids) == t.encode()
    for spoilt in ((packed[4:], chars, ids - np.minimum(ids, 1)), (packed, chars + 1, ids)):
        with pytest.raises(ValueError, match="belong"):
            bpe.checked_bytes(merger, *spoilt)


def test_batches_are_scanned_like_single_texts():
    rng = random.Random(3)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randrange(40))) for _ in range(300)]
    for (tokens, offsets), t in zip(bpe.pre_tokenise(texts), texts, strict=True):
        assert tokens == regex.findall(public_tokenizers.PATTERN, t)
        assert [t[a : a + len(x)] for a, x in zip(offsets, tokens, strict=True)] == tokens


def test_every_code_point_is_split_and_counted_as_the_libraries_do(tools):
    merger, reference, words, counter, byte_level, own = tools
    # of the large uniform blocks every 61st
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c % 61 == 0 or not (0x3500 <= c < 0x9F00 or 0xAC10 <= c < 0xD790 or 0xE010 <= c < 0xF8F0 or c >= 0x20000))]
    for i in range(0, len(points), 2048):
        some = points[i : i + 2048]
        t = "".join(f"a{c}b1{c}2!{c}? {c}{c} \n" for c in some)
        assert np.frombuffer(merger.encode([t])[0], "<u4").tolist() == reference.encode_ordinary(t)
        assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == byte_level.encode(t, add_special_tokens=False).ids
        t = " ".join(f"a{c}b1{c}2!{c}?" for c in some)
        assert sum(map(counter.count, ["", t])) == len(words.encode(t, add_special_tokens=False).ids)
    for t in ("a\u0558" + "1 \u0558b", "x\u0c5cy \ua7ce1", "\U00010940s"):
        assert counter.count(t) == len(words.encode(t, add_special_tokens=False).ids)


def test_long_texts_are_encoded_like_the_libraries_do(tools):
    _, _, words, counter, byte_level, own = tools
    for t in (" " * 2_000_000 + "x", "ab-12/" * 166_667, "\n" * 1_000_000, "x" * 100_000):
        assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == byte_level.encode(t, add_special_tokens=False).ids
        assert counter.count(t) == len(words.encode(t, add_special_tokens=False).ids)


def test_long_runs_merge_like_the_library(tools):
    merger, reference, *_ = tools
    for t in ("ab" * 3000, "世" * 2000, "the" * 1000):
        assert np.frombuffer(merger.encode([t])[0], "<u4").tolist() == reference.encode_ordinary(t)


def test_caches_may_be_emptied_at_any_time(tools, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_LIMIT", 3)
    monkeypatch.setattr(token_counts, "CACHE_LIMIT", 3)
    merger, reference, words, *_ = tools
    counter = token_counts.PieceCounter(WORDS)
    for t in ("a b c d e f g", "h i j a b", "a a a z"):
        assert np.frombuffer(merger.encode([t])[0], "<u4").tolist() == reference.encode_ordinary(t)
        assert counter.count(t) == len(words.encode(t, add_special_tokens=False).ids)


def test_counts_of_odd_rows(odd, none, tools):
    rows = token_counts.count_tokens(odd, WORDS, limit=100).collect()
    assert len(rows) == odd.count() and token_counts.count_tokens(none, WORDS).count() == 0
    want = Counter((r.doc_id, len((r.text or "").encode()), len(tools[2].encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect())
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in rows)


def test_round_trip_of_odd_rows_keeps_extra_columns(odd, none):
    encoded = bpe.bpe_encode(odd, RANKS, offsets="at")
    out = bpe.bpe_decode(encoded, RANKS, offsets="at").select("_id", "_text", "n_tokens", "ids", "at", F.sha2("decoded", 256).alias("h"))
    source = {r["_id"]: r for r in odd.collect()}
    for r in out.collect():
        assert r.h == hashlib.sha256((source[r["_id"]].text or "").encode()).hexdigest()
        assert r["_text"] == source[r["_id"]]["_text"] and r.n_tokens * 4 == len(r.ids)
        assert r["at"]["chars"] == bpe.pre_tokenise([source[r["_id"]].text or ""])[0][1].tolist()
        assert len(r["at"]["ids"]) == len(r["at"]["chars"])
    odd_names = odd.select("text", F.col("n_chars").alias("a.b"))
    assert bpe.bpe_decode(bpe.bpe_encode(odd_names, RANKS), RANKS).columns == ["a.b", "n_tokens", "ids", "decoded"]
    assert bpe.bpe_encode(odd.select("text"), RANKS).columns == ["ids", "n_tokens"]
    for clash in ("ids", "n_tokens"):
        with pytest.raises(ValueError, match="already"):
            bpe.bpe_encode(odd.withColumn(clash, F.lit(1)), RANKS)
    with pytest.raises(ValueError, match="already"):
        bpe.bpe_decode(encoded.withColumn("decoded", F.lit(1)), RANKS)
    assert bpe.bpe_decode(bpe.bpe_encode(none, RANKS), RANKS).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200), st.sampled_from([64, 100, 2048]))
def test_plans_hold_every_piece_once_and_fit(lengths, capacity):
    plan = packing.plan_sequences(dict(Counter(lengths)), capacity)
    got = Counter()
    for count, content in plan:
        assert sum(n * m for n, m in content) <= capacity
        assert sum(m for n, m in content if 3 * n > capacity) <= 2
        for n, m in content:
            got[n] += count * m
    assert got == Counter(lengths)


def test_cut_puts_the_remainder_first():
    assert packing.cut(5, 4) == [(0, 1), (1, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)] and packing.cut(4, 4) == [(0, 4)]


def check_packing(rows, docs, capacity):
    """Every document's ids are covered in order, and every sequence is gapless and fits."""
    tokenizer = Tokenizer.from_file(BYTES)
    ids = {t: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4") for t in {t for _, t in docs}}
    want = Counter((i, k, s, n, zlib.crc32(ids[t][s : s + n].tobytes())) for i, t in docs for k, (s, n) in enumerate(packing.cut(len(ids[t]), capacity)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(sequences)


@pytest.mark.parametrize("block_rows", [20_000, 1])
def test_packing_of_odd_rows(odd, none, monkeypatch, block_rows):
    monkeypatch.setattr(packing, "BLOCK_ROWS", block_rows)
    rows = packing.pack_documents(odd, BYTES, capacity=64).collect()
    used = check_packing(rows, [(r.doc_id, r.text or "") for r in odd.collect()], 64)
    assert used <= 1.1 * -(-sum(r.length for r in rows) // 64) + 1
    assert packing.pack_documents(none, BYTES).count() == 0
