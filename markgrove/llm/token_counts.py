"""Token counts: pieces counted once per distinct pre-token, joined to each document's pre-token frequencies, and summed.

A document becomes a frequency table of pre-tokens; the pieces of a pre-token are
counted the first time a worker meets it and looked up afterwards. No document's
ids are made: the library cuts distinct pre-tokens alone, some hundreds in one
call, and of its answer only the number of pieces of each is read. The join is a
hash look-up inside the task that holds the document: a join by shuffle would move
one row a distinct pre-token of each document, more than the texts themselves, to
save a few merges that cost a microsecond each. The look-up table of a worker is
emptied when it reaches CACHE_LIMIT entries, so its memory does not grow with the
corpus; that changes speed, never counts.

Pre-tokens are cut here as the library cuts them, which is checked for every
character the first time it is met. The two know different versions of Unicode;
a text with a character that they see differently is counted by the library.

Defined results: a null text counts as empty and has 0 tokens; special strings
inside a text are one token each, as the library has them by default; repeated
rows are counted each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from operator import mul

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CACHE_LIMIT = 400_000
_COUNTERS: dict[str, PieceCounter] = {}


class PieceCounter:
    """Counts the tokens of a text under a BPE ``.json`` file of the tokenizers library whose pre-tokenizer drops white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        spec = json.load(open(path, encoding="utf-8"))
        self._library = Tokenizer.from_file(path)
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self._marks = {t[0] for t in special}
        self._normal = self._normaliser(spec["normalizer"])
        self._split = regex.compile(self._pattern(spec["pre_tokenizer"]))
        self._pieces: dict[str, int] = {}
        self._known: set[str] = set(map(chr, range(128)))
        self._odd: set[str] = set()
        self._glue = " "  # dropped by the pre-tokenizer, so pre-tokens stay apart

    @staticmethod
    def _normaliser(spec: dict | None) -> Callable[[str], str]:
        steps = [] if spec is None else spec["normalizers"] if spec["type"] == "Sequence" else [spec]
        kinds = [s["type"] for s in steps]
        if [k for k in kinds if k not in ("NFC", "Replace", "Lowercase")]:
            raise ValueError(f"unsupported normalizers: {kinds}")
        # a Replace of white space by a space cannot change pre-tokens that hold no white space
        def run(text: str) -> str:
            if "NFC" in kinds:
                text = unicodedata.normalize("NFC", text)
            if "Lowercase" in kinds:  # a letter at a time: no final sigma
                text = text.replace("Σ", "σ").lower()
            return text

        return run

    @staticmethod
    def _pattern(spec: dict) -> str:
        parts = spec.get("pretokenizers", [])
        if [p["type"] for p in parts] == ["Split", "ByteLevel"] and parts[0]["behavior"] == "Removed" and parts[0]["invert"]:
            return parts[0]["pattern"]["Regex"]
        raise ValueError("unsupported pre-tokenizer")

    def _count_new(self, tokens: list[str]) -> None:
        """Count the pieces of distinct pre-tokens, some hundreds in one call: apart, each is a word to the library."""
        for i in range(0, len(tokens), 256):
            some = tokens[i : i + 256]
            words = self._library.encode(self._glue.join(some), add_special_tokens=False).word_ids
            counts = np.bincount(np.array(words, np.int64), minlength=len(some))
            if len(counts) != len(some):
                raise ValueError("a pre-token was split again")  # all its characters are known to be cut alike
            self._pieces.update(zip(some, counts.tolist(), strict=True))

    def _look(self, characters: set[str]) -> None:
        """Find out which of ``characters`` the library normalises, orders or cuts in another way."""
        normal, cut = self._library.normalizer.normalize_str, self._library.pre_tokenizer.pre_tokenize_str
        for c in characters:
            alike = all(normal(t) == self._normal(t) for t in (c, f"a\u0315{c}\u0300\u0323"))
            for t in (f"a{c}a", f"1{c}1", f"!{c}!"):
                t = self._normal(t)
                alike = alike and [t[a:b] for _, (a, b) in cut(t)] == self._split.findall(t)
            if not alike:
                self._odd.add(c)
        self._known |= characters

    def count(self, text: str) -> int:
        """Tokens of ``text`` without begin, end or other added tokens."""
        if not text.isascii():
            characters = set(text)
            if not characters <= self._known:
                self._look(characters - self._known)
            if self._odd and not self._odd.isdisjoint(characters):
                return len(self._library.encode(text, add_special_tokens=False))
        n, parts = 0, (text,)
        if self._special is not None and any(m in text for m in self._marks):
            parts = self._special.split(text)
            n = len(parts) - 1
        for part in parts:
            frequency = Counter(self._split.findall(self._normal(part)))
            if new := [t for t in frequency if t not in self._pieces]:
                self._count_new(new)
            n += sum(map(mul, frequency.values(), map(self._pieces.__getitem__, frequency)))
            if len(self._pieces) > CACHE_LIMIT:
                self._pieces = {}
        return n


def piece_counter(path: str) -> PieceCounter:
    """The worker's counter for ``path``, kept between tasks."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 2048, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_tokens, over_limit (n_tokens > ``limit``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(path)
        for batch in batches:
            texts = batch.column(1)
            counts = [counter.count(t.as_py() or "") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), batch.column(2)], names=[key, "n_tokens", "n_bytes"])

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).cast("long").alias(key), body.alias(text), F.octet_length(body).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(run, f"`{key}` long, n_tokens long, n_bytes long")
    return out.select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
