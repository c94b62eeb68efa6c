"""Byte-level BPE encoding and decoding with a vectorised pre-tokeniser.

Pre-tokens are found without regular expressions. Code points become symbols
(letter, number, other, apostrophe of a contraction, white space inside or at the
end of its run; the first symbol of a text is marked). An automaton of eight
states reads the symbols; as every symbol is a function from states to states and
functions compose associatively, a whole batch is scanned at once: all blocks of
the batch compose their functions side by side, a prefix scan over the blocks
gives each its starting state, and a second side-by-side pass marks where
pre-tokens begin. The resulting slices go through a bounded cache of merged pairs.

Ids are packed as little-endian unsigned 32-bit integers in a binary column. With
them the offsets of every pre-token are retained on request: its first code point
and its first id. Decoding by the offsets finds for every pre-token the bytes of its
ids and checks that they begin at its code point, so that lost or shifted ids before
it are an error and not another text.

Defined results: a null text is encoded as empty, to no ids; a null list of ids
decodes to no bytes; repeated rows are encoded each; an empty table gives no
rows; extra columns are carried along unread, whatever their names, but a column
that has the name of a new one is refused (ValueError).
"""

from __future__ import annotations

import base64
import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

CACHE_LIMIT = 400_000
#: Slices of more characters than this are merged by a heap.
LONG_PIECE = 400
#: Bytes of text scanned at a time, about, and code points in one block of the scan.
BATCH_BYTES, BLOCK = 1 << 19, 64

_LETTER, _NUMBER, _OTHER, _APO2, _APO3, _SPACE_IN, _SPACE_LAST, _BLANK_LAST = range(8)
_FREE, _IN_L, _IN_N, _IN_O, _IN_W, _ABSORBED, _ONE_MORE, _TWO_MORE = range(8)
#: White_Space of Unicode.
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a pre-token begins here", both by symbol * 8 + state; symbols from 8 on begin a text."""
    after, begins = np.zeros((16, 8), np.uint8), np.zeros((16, 8), bool)
    for symbol in range(8):
        for state in range(8):
            if state in (_ONE_MORE, _TWO_MORE):
                new, begin = (_FREE if state == _ONE_MORE else _ONE_MORE), False
            elif symbol in (_LETTER, _NUMBER, _OTHER):
                new = (_IN_L, _IN_N, _IN_O)[symbol]
                begin = state not in (new, _ABSORBED)
            elif symbol in (_APO2, _APO3):
                inside = state in (_IN_O, _ABSORBED)
                new, begin = (_IN_O, False) if inside else (_ONE_MORE if symbol == _APO2 else _TWO_MORE, True)
            elif symbol == _SPACE_IN:
                new, begin = _IN_W, state != _IN_W
            else:
                new, begin = (_FREE if symbol == _SPACE_LAST else _ABSORBED), True
            after[symbol, state], begins[symbol, state] = new, begin
    after[8:], begins[8:] = after[:8, _FREE : _FREE + 1], begins[:8, _FREE : _FREE + 1]
    return after.ravel(), begins.ravel()


_AFTER, _BEGINS = _automaton()
_CLASS: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Letter, number, other or white space by code point."""
    if not _CLASS:
        import regex

        points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        every = "".join(map(chr, points))
        table = np.full(0x110000, _OTHER, np.uint8)
        for pattern, kind in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER)):
            for m in regex.finditer(pattern, every):
                table[points[m.start()] : points[m.end() - 1] + 1] = kind
        table[0xD800:0xE000] = _OTHER
        table[_WHITE] = _SPACE_IN
        _CLASS.append(table)
    return _CLASS[0]


class LibraryClasses:
    """The classes that a byte-level tokenizer of the tokenizers library sees: its Unicode version is its own.

    A code point is asked about the first time it is met: what stays one pre-token
    between letters is a letter, and so on.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self._table, self._known = _classes().copy(), np.arange(0x110000) < 128

    def _joined(self, points: list[int], around: str) -> np.ndarray:
        found = {at for _, at in self._split("".join(f"{around}{chr(c)}{around}\n" for c in points))}
        return np.array([(4 * i, 4 * i + 3) in found for i in range(len(points))])

    def __getitem__(self, points: np.ndarray) -> np.ndarray:
        if not self._known[points].all():
            new = np.unique(points[~self._known[points]])
            for c in np.array_split(new, -(-len(new) // 4096)):
                asked = c.tolist()
                kinds = [self._joined(asked, a) for a in "a1!"]
                self._table[c] = np.select(kinds, [_LETTER, _NUMBER, _OTHER], _SPACE_IN)
            self._known[new] = True
        return self._table[points]


def symbols(points: np.ndarray, firsts: np.ndarray, classes: np.ndarray | LibraryClasses | None = None) -> np.ndarray:
    """The automaton's symbols of concatenated texts; ``firsts`` are the indices at which non-empty texts begin."""
    sym = (_classes() if classes is None else classes)[points]
    n = len(points)
    ends = np.zeros(n + 1, bool)  # ends[i]: no character of the same text at i
    ends[firsts] = True
    ends[n] = True
    white = sym == _SPACE_IN
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:] & ~ends[1:-1]
    sym[last] = np.where(points[last] == 32, _BLANK_LAST, _SPACE_LAST)
    at = np.flatnonzero(points == 39)
    if len(at):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[at + 1], padded[at + 2]
        in_one = ~ends[at + 1]
        in_two = in_one & ~ends[np.minimum(at + 2, n)]
        short = in_one & np.isin(one, [ord(c) for c in "stmd"])
        long = in_two & (((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l"))))
        sym[at[short]] = _APO2
        sym[at[long]] = _APO3
    sym[firsts] += 8
    return sym


def scan(sym: np.ndarray) -> np.ndarray:
    """The indices at which pre-tokens begin."""
    n = len(sym)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, _LETTER, np.uint8)
    padded[:n] = sym
    rows = np.ascontiguousarray(padded.reshape(blocks, BLOCK).T).astype(np.intp) << 3
    function = np.broadcast_to(np.arange(8, dtype=np.intp), (blocks, 8))
    for t in range(BLOCK):  # every block composes its symbols, state by state
        function = _AFTER[rows[t][:, None] + function]
    prefix = function.astype(np.intp)
    step = 1
    while step < blocks:  # prefix scan over the blocks: compositions of 2, 4, 8... of them
        composed = np.take_along_axis(prefix[step:], prefix[:-step], axis=1)
        prefix = np.concatenate([prefix[:step], composed])
        step *= 2
    state = np.full(blocks, _FREE, np.intp)
    state[1:] = prefix[:-1, _FREE]
    begins = np.empty((BLOCK, blocks), bool)
    for t in range(BLOCK):
        at = rows[t] + state
        begins[t] = _BEGINS[at]
        state = _AFTER[at]
    return np.flatnonzero(begins.T.reshape(-1)[:n])


def pre_tokenise(texts: list[str], classes: np.ndarray | LibraryClasses | None = None) -> list[tuple[list[str], np.ndarray]]:
    """For each text its pre-tokens and their code-point offsets."""
    whole = "".join(texts)
    lengths = np.array([len(t) for t in texts], np.int64)
    edges = np.concatenate([[0], np.cumsum(lengths)])
    if not whole:
        return [([], np.zeros(0, np.int64)) for _ in texts]
    points = np.frombuffer(whole.encode("utf-32-le"), "<u4")
    starts = scan(symbols(points, edges[:-1][lengths > 0], classes))
    ends = np.append(starts[1:], len(whole)).tolist()
    slices = [whole[a:b] for a, b in zip(starts.tolist(), ends, strict=True)]
    cut = np.searchsorted(starts, edges)
    return [(slices[a:b], starts[a:b] - e) for a, b, e in zip(cut[:-1].tolist(), cut[1:].tolist(), edges[:-1].tolist(), strict=True)]


def pack(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _byte_letters() -> dict[str, int]:
    """The byte behind each letter of a byte-level vocabulary: printable Latin-1 stands for itself, the rest follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks and special strings of a rank file, or of a byte-level ``.json`` file whose ids follow its merges."""
    if not path.endswith(".json"):
        with open(path, "rb") as f:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, {}
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec["normalizer"] is not None or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
        raise ValueError("only byte-level tokenizers without a normalizer are supported")
    unbyte = _byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return {bytes(unbyte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}, special


class _Cache(dict):
    """Packed ids by slice, made when first asked for."""

    def __init__(self, merged):
        self._merged = merged

    def __missing__(self, piece: str) -> bytes:
        packed = self[piece] = pack(self._merged(piece))
        return packed


class PairMerger:
    """Ids of pre-tokens by the ranks of byte pairs, packed, in a bounded cache."""

    def __init__(self, path: str):
        import tiktoken

        self.ranks, self.special = read_vocabulary(path)
        self.tokens = {b: a for a, b in self.ranks.items()} | {i: t.encode() for t, i in self.special.items()}
        self._parts = re.compile(f"({'|'.join(map(re.escape, sorted(self.special, key=len, reverse=True)))})") if self.special else None
        self.classes = LibraryClasses(path) if path.endswith(".json") else None
        self.cache = _Cache(self.merged)
        # the pattern takes a slice whole: the library only merges pairs
        self._merge = tiktoken.Encoding("slices", pat_str=r"(?s:.+)", mergeable_ranks=self.ranks, special_tokens={}).encode_ordinary

    def merged(self, piece: str) -> list[int]:
        """Merge the adjacent pair of lowest rank, leftmost first, until none has a rank."""
        return self._merge(piece) if len(piece) <= LONG_PIECE else self._merged_long(piece.encode())

    def _merged_long(self, piece: bytes) -> list[int]:
        """The same by a heap and a linked list, in n log n steps: for runs without a break for pages."""
        ranks, n = self.ranks, len(piece)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            if parts[i] is None or (j := right[i]) >= n or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = None
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < n and (r := ranks.get(parts[a] + parts[b])) is not None:
                    heapq.heappush(heap, (r, a, len(parts[a]) + len(parts[b])))
        return [ranks[p] for p in parts if p is not None]

    def packed(self, tokens: list[str]) -> list[bytes]:
        if len(self.cache) > CACHE_LIMIT:
            self.cache.clear()
        return list(map(self.cache.__getitem__, tokens))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text; special strings of the vocabulary are one id each."""
        if not any(s in t for t in texts for s in self.special):
            return self.encode_ordinary(texts)
        split = [self._parts.split(t) for t in texts]
        ordinary = iter(self.encode_ordinary([p for parts in split for p in parts[::2]]))
        marks = [[pack([self.special[p]]) for p in parts[1::2]] for parts in split]
        return [b"".join(next(ordinary) + m for m in [*some, b""]) for some in marks]

    def encode_ordinary(self, texts: list[str]) -> list[bytes]:
        return [b"".join(self.packed(tokens)) for tokens, _ in pre_tokenise(texts, self.classes)]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_MERGERS: dict[str, PairMerger] = {}


def pair_merger(path: str) -> PairMerger:
    """The worker's merger for ``path``, kept between tasks."""
    if path not in _MERGERS:
        _MERGERS[path] = PairMerger(path)
    return _MERGERS[path]


OFFSETS = T.StructType([T.StructField("chars", T.ArrayType(T.IntegerType())), T.StructField("ids", T.ArrayType(T.IntegerType()))])


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *arrays]).astype(np.int32)))


def _carried(docs: DataFrame, out: list[str], *used: str) -> DataFrame:
    """``row`` (a struct of all columns that stay) and the columns ``used``; new columns must not clash."""
    clash = [c for c in docs.columns if c in out]
    if clash:
        raise ValueError(f"the input has columns {clash} already")
    keep = [F.col(f"`{c}`") for c in docs.columns if c != used[0]]
    return docs.select(F.struct(F.lit(0).alias("_"), *keep).alias("row"), *[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(used)])


def _unpacked(df: DataFrame, docs: DataFrame, used: str, out: list[str]) -> DataFrame:
    return df.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != used], *out)


def bpe_encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", offsets: str | None = None) -> DataFrame:
    """``docs`` with ``text`` replaced by ``ids`` (packed) and ``n_tokens``; ``offsets`` names a column for those of the pre-tokens (OFFSETS)."""
    out = [ids, "n_tokens", *([offsets] if offsets else [])]
    rows = _carried(docs, out, text)
    fields = [rows.schema["row"], T.StructField(ids, T.BinaryType()), T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField(offsets, OFFSETS)] if offsets else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = pair_merger(path)
        for batch in (s for b in batches for s in slices(b, 1, BATCH_BYTES)):
            packed, chars, firsts = [], [], []
            for tokens, where in pre_tokenise([t.as_py() or "" for t in batch.column(1)], merger.classes):
                parts = merger.packed(tokens)
                packed.append(b"".join(parts))
                if offsets:
                    chars.append(where)
                    firsts.append(np.cumsum([0, *map(len, parts)])[:-1] // 4)
            columns = [batch.column(0), pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64())]
            columns += [pa.StructArray.from_arrays([_lists(chars), _lists(firsts)], ["chars", "ids"])] if offsets else []
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return _unpacked(rows.mapInArrow(run, T.StructType(fields)), docs, text, out)


def checked_bytes(merger: PairMerger, packed: bytes, chars: np.ndarray, ids: np.ndarray) -> bytes:
    """The bytes of packed ids, of which those from ``ids[i]`` on must begin at code point ``chars[i]``."""
    parts = list(map(merger.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))
    whole = b"".join(parts)
    at = np.cumsum([0, *map(len, parts)])[ids]
    begins = (np.frombuffer(whole, np.uint8) & 0xC0) != 0x80  # a byte that begins a code point
    points = np.concatenate([[0], np.cumsum(begins)])
    if not (np.array_equal(points[at], chars) and begins[at].all()):
        raise ValueError("ids and offsets of pre-tokens do not belong together")
    return whole


def bpe_decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded", offsets: str | None = None) -> DataFrame:
    """``docs`` with the bytes of packed ``ids`` in a binary column ``out``; ``ids`` stays. With ``offsets``, pre-token by pre-token."""
    rows = _carried(docs, [out], ids, *([offsets] if offsets else []))
    fields = [rows.schema["row"], T.StructField(ids, T.BinaryType()), T.StructField(out, T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger = pair_merger(path)
        for batch in (s for b in batches for s in slices(b, 1, BATCH_BYTES)):
            packed = [p.as_py() or b"" for p in batch.column(1)]
            if offsets:
                none = np.zeros(0, np.int32)
                pair = [(o["chars"].values.to_numpy(), o["ids"].values.to_numpy()) if o.is_valid else (none, none) for o in batch.column(2)]
                decoded = [checked_bytes(merger, p, *o) for p, o in zip(packed, pair, strict=True)]
            else:
                decoded = [merger.decode(p) for p in packed]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(decoded, pa.binary())], names=[f.name for f in fields])

    return _unpacked(rows.mapInArrow(run, T.StructType(fields)), docs, ids, [ids, out])
