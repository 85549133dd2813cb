"""Byte-level BPE encoding and decoding (operator 6).

A text is cut into pieces by the vocabulary's pattern; a piece that is a
token is that token, any other is merged from its bytes: a segment tree over
the byte positions holds, at each live left neighbour, the rank of the pair
it starts, and at its root the leftmost smallest rank.  A merge updates
three leaves (the merged pair, its left neighbour's, the vanished right
one's), each along one path to the root, so a piece of n bytes costs
O(n log n).

Short pieces, which are nearly all, are merged many at a time: one numpy row
per piece, the trees of a batch side by side (``merge_batch``); long ones one
by one (``merge_long``).  A bounded memo keeps the pieces met most recently
(it is emptied when full, which costs time, not results).

The vocabulary (a file of fixed size, not data that grows) is read on the
driver and broadcast once.

Defined results: null text is empty; an empty text has no tokens; decoding
returns the exact bytes; repeated rows are encoded one by one; other columns
pass through when packed by the caller.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shopstat.llm.tokens import parts

NONE = np.int64(1) << 62        # larger than any rank * size + position
LONG_PIECE = 256                # bytes; longer pieces are merged one by one
MEMO_PIECES = 150_000
BATCH_CELLS = 1 << 16
BATCH_BYTES = 1 << 18

# The pattern's classes written out for characters below U+02C2, where they
# are fixed; texts with other characters take the pattern itself.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ˁ"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\t-\r \x85\xa0"
_PLAIN = (rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken file: base64 of the bytes, a blank, the rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Bpe:
    """Encoder and decoder for one vocabulary.  Token ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.byte_ids = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary lacks a single-byte token")
        # every split of a token into two tokens is a pair that merges into it
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[(left << 20) | right] = rank
        self.pair_rank = pairs
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        order = np.argsort(keys)
        self.pair_keys = keys[order]
        self.pair_values = np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))[order]
        self.pattern = regex.compile(pattern)
        self.plain = re.compile(_PLAIN) if pattern == _public_pattern() else None
        self.other = re.compile("[^\x00-ˁ]")
        self.memo = Memo()
        top = max(ranks.values()) + 1
        tokens = {i: t for t, i in ranks.items()}
        self.token_bytes, self.token_starts = _table([tokens.get(i, b"") for i in range(top)])
        self.decimals, self.decimal_starts = _table([b"%d " % i for i in range(top)])

    # -- pieces ---------------------------------------------------------
    def pieces(self, text: str) -> list[str]:
        if self.plain is not None and (text.isascii() or not self.other.search(text)):
            return self.plain.findall(text)
        return self.pattern.findall(text)

    # -- merging --------------------------------------------------------
    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the two don't merge."""
        key = (left << 20) | right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_values[at], NONE)

    def merge_batch(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Merge pieces of 1 to ``size`` bytes, ``size`` the power of two
        that holds the longest; row r of every array belongs to piece r.
        Returns the ids of all pieces in a row, and how many each has."""
        n, longest = len(pieces), max(map(len, pieces))
        size = 1 << (longest - 1).bit_length() if longest > 1 else 2
        lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), dtype=np.uint8).reshape(n, size)
        token = self.byte_ids[raw]
        cols = np.arange(size)
        after = np.tile(np.arange(1, size + 2), (n, 1))[:, :size + 1]      # next live position
        before = np.tile(np.arange(-1, size), (n, 1))                      # previous one; column ``size`` is a stop
        tree = np.full((n, 2 * size), NONE, dtype=np.int64)
        pair = self._ranks_of(token[:, :-1].ravel(), token[:, 1:].ravel()).reshape(n, size - 1)
        pair = np.where((cols[1:] < lengths[:, None]) & (pair < NONE), pair * size + cols[:-1], NONE)
        tree[:, size:2 * size - 1] = pair
        width = size
        while width > 1:
            half = width // 2
            tree[:, half:width] = np.minimum(tree[:, width:2 * width:2], tree[:, width + 1:2 * width:2])
            width = half
        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            top = tree[live, 1]
            at, rank = top % size, top // size
            gone = after[live, at]
            then = after[live, gone]
            token[live, at] = rank
            after[live, at] = then
            before[live, np.minimum(then, size)] = at
            self._put(tree, live, gone, np.full(len(live), NONE), size)
            has = then < lengths[live]
            value = np.full(len(live), NONE)
            if has.any():
                r = self._ranks_of(rank[has], token[live[has], then[has]])
                value[has] = np.where(r < NONE, r * size + at[has], NONE)
            self._put(tree, live, at, value, size)
            prev = before[live, at]
            has = prev >= 0
            if has.any():
                rows, p = live[has], prev[has]
                r = self._ranks_of(token[rows, p], rank[has])
                self._put(tree, rows, p, np.where(r < NONE, r * size + p, NONE), size)
            live = live[tree[live, 1] < NONE]
        alive = np.zeros((n, size), dtype=bool)
        alive[:, 0] = True
        rows, pos = np.arange(n), np.zeros(n, dtype=np.int64)
        while len(rows):
            pos = after[rows, pos]
            more = pos < lengths[rows]
            rows, pos = rows[more], pos[more]
            alive[rows, pos] = True
        return token[alive], alive.sum(axis=1)

    @staticmethod
    def _put(tree: np.ndarray, rows: np.ndarray, pos: np.ndarray, value: np.ndarray, size: int) -> None:
        """Point update of one leaf per row, along its path to the root."""
        node = pos + size
        tree[rows, node] = value
        while size > 1:
            value = np.minimum(value, tree[rows, node ^ 1])
            node = node >> 1
            tree[rows, node] = value
            size >>= 1

    def merge_long(self, piece: bytes) -> list[int]:
        """The same merging for one piece of any length."""
        n = len(piece)
        size = 1 << (n - 1).bit_length() if n > 1 else 2
        none = int(NONE)
        token = self.byte_ids[np.frombuffer(piece, dtype=np.uint8)]
        tree_start = np.full(2 * size, none, dtype=np.int64)
        pair = self._ranks_of(token[:-1], token[1:])
        tree_start[size:size + n - 1] = np.where(pair < NONE, pair * size + np.arange(n - 1), none)
        width = size
        while width > 1:
            half = width // 2
            tree_start[half:width] = np.minimum(tree_start[width:2 * width:2], tree_start[width + 1:2 * width:2])
            width = half
        tree, token = tree_start.tolist(), token.tolist()
        after, before, find = list(range(1, n + 1)) + [n], list(range(-1, n)), self.pair_rank.get

        def put(pos: int, rank: int | None) -> None:
            node = pos + size
            tree[node] = none if rank is None else rank * size + pos
            node >>= 1
            while node:
                a, b = tree[2 * node], tree[2 * node + 1]
                tree[node] = a if a < b else b
                node >>= 1

        while tree[1] < none:
            rank, at = divmod(tree[1], size)
            gone = after[at]
            then = after[gone]
            token[at], after[at] = rank, then
            if then <= n:
                before[then] = at
            put(gone, None)
            put(at, find((rank << 20) | token[then]) if then < n else None)
            prev = before[at]
            if prev >= 0:
                put(prev, find((token[prev] << 20) | rank))
        ids, at = [], 0
        while at < n:
            ids.append(token[at])
            at = after[at]
        return ids

    def _learn(self, missing: list[str]) -> None:
        """Put pieces that the memo lacks into it."""
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for piece in missing:
            raw = piece.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                self.memo.add([piece], np.array([whole]), np.array([1]))
            elif len(raw) > LONG_PIECE:
                ids = np.array(self.merge_long(raw))
                self.memo.add([piece], ids, np.array([len(ids)]))
            else:
                by_size.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for bits, group in by_size.items():
            step = max(1, BATCH_CELLS >> bits)     # the trees of a batch stay in the processor's cache
            for i in range(0, len(group), step):
                part = group[i:i + step]
                self.memo.add([p for p, _ in part], *self.merge_batch([raw for _, raw in part]))

    # -- texts ----------------------------------------------------------
    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in a row, and where each text's begin and
        the last one's end (one more than there are texts)."""
        if len(self.memo.index) > MEMO_PIECES:
            self.memo = Memo()
        cut = [self.pieces(t) for t in texts]
        flat = list(chain.from_iterable(cut))
        at = np.fromiter(map(self.memo.index.get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            self._learn(list(dict.fromkeys(flat[i] for i in missing)))
            at[missing] = [self.memo.index[flat[i]] for i in missing]
        ids, ends = take_runs(self.memo.ids, self.memo.starts, at)
        ends = np.concatenate(([0], ends))
        return ids, ends[np.concatenate(([0], np.cumsum([len(p) for p in cut], dtype=np.int64)))]

    def decode_flat(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and where each id's end."""
        return take_runs(self.token_bytes, self.token_starts, ids)

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_flat(np.asarray(ids, dtype=np.int64))[0].tobytes()


class Memo:
    """Pieces met, their ids in one growing array."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, dtype=np.int32)
        self.starts = np.zeros(1 << 16, dtype=np.int64)

    def add(self, pieces: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        n = len(self.index)
        self.index.update(zip(pieces, range(n, n + len(pieces))))
        end = int(self.starts[n])
        while n + len(pieces) >= len(self.starts):
            self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
        while end + len(ids) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[end:end + len(ids)] = ids
        self.starts[n + 1:n + 1 + len(pieces)] = end + np.cumsum(counts)


def take_runs(store: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``store[starts[k]:starts[k + 1]]`` for every k of ``which``, in a row,
    and where each run ends there."""
    begin = starts[which]
    length = starts[which + 1] - begin
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    return store[np.repeat(begin - ends + length, length) + np.arange(total)], ends


def _table(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate(([0], np.cumsum([len(v) for v in values], dtype=np.int64)))
    return np.frombuffer(b"".join(values), dtype=np.uint8), starts


def _public_pattern() -> str:
    import public_tokenizers
    return public_tokenizers.PATTERN


_BUILT: list = []


def _shared(vocabulary) -> Bpe:
    """One encoder per Python worker, kept while the vocabulary stays the same."""
    if not _BUILT or _BUILT[0] is not vocabulary.value:
        _BUILT[:] = [vocabulary.value, Bpe(*vocabulary.value)]
    return _BUILT[1]


def broadcast_vocabulary(spark: SparkSession, path: str, pattern: str):
    return spark.sparkContext.broadcast((load_ranks(path), pattern))


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column("text").to_pylist()]


def encoded_batches(batches: Iterator[pa.RecordBatch], vocabulary) -> Iterator[tuple[pa.RecordBatch, tuple[np.ndarray, np.ndarray]]]:
    """Parts of the batches with the token ids of their ``text`` in a row and
    where each text's begin."""
    bpe = _shared(vocabulary)
    for batch in parts(batches, size=BATCH_BYTES):
        yield batch, bpe.encode_batch(_texts(batch))


def encode(docs: DataFrame, path: str, pattern: str, out: str = "ids") -> DataFrame:
    """Adds ``out``, the token ids of the whole ``text``; other columns stay."""
    vocabulary = broadcast_vocabulary(docs.sparkSession, path, pattern)
    kept = [c for c in docs.columns if c != out]
    schema = docs.select(*[f"`{c}`" for c in kept], F.array().cast("array<int>").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, (ids, starts) in encoded_batches(batches, vocabulary):
            found = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [found], names=[*kept, out])
    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``, the bytes that the ids stand for (null ids: null)."""
    vocabulary = broadcast_vocabulary(encoded.sparkSession, path, pattern)
    kept = [c for c in encoded.columns if c != out]
    schema = encoded.select(*[f"`{c}`" for c in kept], F.lit(b"").cast("binary").alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _shared(vocabulary)
        for batch in batches:
            raw = [None if x is None else bpe.decode(x) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(raw, pa.binary())], names=[*kept, out])
    return encoded.mapInArrow(run, schema)


def report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: token count and digests of the ids and of the decoded
    bytes.  Encoding and decoding run in one pass per batch, so that the ids
    of the whole corpus needn't travel between two Python stages."""
    vocabulary = broadcast_vocabulary(docs.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _shared(vocabulary)
        for batch, (ids, starts) in encoded_batches(batches, vocabulary):
            numbers, number_ends = take_runs(bpe.decimals, bpe.decimal_starts, ids)
            decoded, decoded_ends = bpe.decode_flat(ids)
            n_at, d_at = (np.concatenate(([0], e))[starts].tolist() for e in (number_ends, decoded_ends))
            # each number is followed by a blank; the last one's isn't hashed
            id_digests = [hashlib.sha256(numbers[a:max(a, b - 1)]).hexdigest() for a, b in zip(n_at, n_at[1:])]
            text_digests = [hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(d_at, d_at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(starts), pa.int64()), pa.array(id_digests, pa.string()),
                 pa.array(text_digests, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    doc_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {doc_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
