"""Benchmark decontamination: BM25 over an inverted index of the test items
with block-max WAND (operator 8).

Index.  Items are cut into units of at most ``UNIT`` words.  A posting holds
a term's BM25 weight in a unit, divided by the unit's full score, so a
passage's score for a unit is the share (0 to 1) of the unit's weight that
its words carry.  Postings lie in blocks of ``BLOCK`` units, each with the
largest weight per term.

Search.  Every window of two neighbouring ``UNIT``-word stretches of every
training document is a query (any unit lies whole in some window); all units
with a score of at least ``THRESHOLD`` are retrieved.  Because the threshold
is fixed, WAND's pivot test can be made for a batch of queries at once: in
each unit the light terms that together stay under half the threshold can't
carry a passage over it, so only the postings of the other, essential terms
are walked; a window goes on with a block only if its essential terms' block
maxima plus the block's largest light rest reach the threshold, then with a
unit only if its own essential postings plus its light rest do; what is left
is scored exactly.

Verification: at least ``OVERLAP`` of the item's question's words and of its
answer's words (the last sentence; of one sentence, its second half) must be
there, in their order, within the retrieved windows.  The share of the item's five-word
shingles in the document is reported, not judged.

An index above ``MAX_INDEX_BYTES`` of item text (checked before it is
gathered) is searched in shards, one written pass over the documents each;
the driver holds one shard at a time.

Defined results: null or empty texts and items match nothing; items shorter
than five words count as one shingle; repeated documents are searched one by
one; one row per document and item found.  A document without an id has its
rows with a null id; items without an id can't be named and are left out.  An
empty table on either side finds nothing; columns of the caller that are named
like an operator's own stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopstat.llm.common import materialise
from shopstat.llm.tokens import Words, parts, run_hashes, words_of

UNIT, BLOCK = 64, 64
K1, B = 1.2, 0.75
THRESHOLD = 0.5
SHINGLE, OVERLAP = 5, 0.8
MAX_INDEX_BYTES = 32 << 20


@dataclass
class Item:
    item_id: int
    hashes: np.ndarray         # word hashes in order
    shingles: np.ndarray       # distinct shingle hashes
    question: np.ndarray       # distinct word hashes
    answer: np.ndarray
    last: int                  # where the answer begins


def _shingles(h: np.ndarray) -> np.ndarray:
    return np.unique(run_hashes(h, min(SHINGLE, len(h)))) if len(h) else np.zeros(0, dtype=np.uint64)


def _item(item_id: int, text: str) -> Item | None:
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text) if s.strip()]
    w = words_of(pa.array(sentences or [""], pa.string()))
    h = w.hash
    if not len(h):
        return None
    last = int(w.first[len(sentences) - 1]) if len(sentences) > 1 else 0
    if not 0 < last < len(h):
        last = len(h) // 2
    return Item(item_id, h, _shingles(h), np.unique(h[:last]), np.unique(h[last:]), last)


def in_order(wanted: np.ndarray, words: np.ndarray) -> float:
    """The share of ``wanted`` that stands among ``words`` in its order: the
    longest common subsequence, a row of its table per step in one whole number."""
    if not len(wanted):
        return 1.0
    places: dict[int, int] = {}
    for i, x in enumerate(wanted.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(wanted)) - 1
    row = full
    for x in words.tolist():
        hit = row & places.get(x, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & full
    return (len(wanted) - row.bit_count()) / len(wanted)


def _ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """All positions ``start[i] .. start[i] + count[i] - 1``, in a row."""
    ends = np.cumsum(count)
    return np.repeat(start - ends + count, count) + np.arange(int(ends[-1]) if len(ends) else 0)


class Index:
    """Inverted index of the items; arrays only, made once per shard."""

    def __init__(self, items: list[tuple[int, str]]):
        made = [i for i in (_item(n, t) for n, t in items if n is not None and t) if i is not None]
        self.items = {k: item for k, item in enumerate(made)}
        unit_item, words = [], []
        for k, item in self.items.items():
            for a in range(0, len(item.hashes), UNIT):
                unit_item.append(k)
                words.append(item.hashes[a:a + UNIT])
        self.unit_item = np.array(unit_item, dtype=np.int64)
        n = len(words)
        self.units = n
        if not n:
            return
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        vocab, term = np.unique(np.concatenate(words), return_inverse=True)
        unit = np.repeat(np.arange(n), lengths)
        key, tf = np.unique(term * n + unit, return_counts=True)
        term, unit = key // n, key % n
        df = np.bincount(term, minlength=len(vocab))
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[unit] / lengths.mean()))
        weight = weight / np.bincount(unit, weights=weight, minlength=n)[unit]
        self.vocab, self.term, self.unit, self.weight = vocab, term, unit, weight
        self.posting_start = np.searchsorted(term, np.arange(len(vocab) + 1))
        # light terms of each unit: the smallest weights that together stay below half the threshold
        order = np.lexsort((weight, unit))
        sums = np.cumsum(weight[order])
        unit_first = np.searchsorted(unit[order], np.arange(n))
        within = sums - (sums[unit_first] - weight[order][unit_first])[unit[order]]
        light = np.zeros(len(weight), dtype=bool)
        light[order] = within < THRESHOLD / 2
        self.rest = np.bincount(unit[light], weights=weight[light], minlength=n)
        # essential postings, by term, and their block maxima
        e = np.flatnonzero(~light)
        self.e_vocab, e_term = np.unique(term[e], return_inverse=True)
        self.e_hash = vocab[self.e_vocab]
        self.e_unit, self.e_weight = unit[e], weight[e]
        self.e_start = np.searchsorted(e_term, np.arange(len(self.e_vocab) + 1))
        blocks = n // BLOCK + 1
        bkey, first = np.unique(e_term * blocks + self.e_unit // BLOCK, return_index=True)
        self.b_max = np.maximum.reduceat(self.e_weight, first)
        self.b_block, b_term = bkey % blocks, bkey // blocks
        self.b_start = np.searchsorted(b_term, np.arange(len(self.e_vocab) + 1))
        self.b_rest = np.zeros(blocks)
        np.maximum.at(self.b_rest, np.arange(n) // BLOCK, self.rest)
        # a small first test that most words fail: does any essential term share the low bits?
        self.sieve = np.zeros(1 << 20, dtype=bool)
        self.sieve[self.e_hash & np.uint64((1 << 20) - 1)] = True

    # -- search -----------------------------------------------------------
    def _windows(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretch number of each word, and per stretch whether the next one
        belongs to the same text, so that the two form a window."""
        at = np.arange(len(w.hash)) - w.first[w.text]
        per_text = -(-np.diff(w.first) // UNIT)
        base = np.concatenate(([0], np.cumsum(per_text)))
        stretch = base[w.text] + at // UNIT
        owner = np.repeat(np.arange(len(per_text)), per_text)
        paired = np.zeros(len(owner), dtype=bool)
        paired[:-1] = owner[1:] == owner[:-1]
        return stretch, owner, paired

    def candidates(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows (by their first stretch) and units that pass the bounds,
        with the text of each."""
        none = np.zeros(0, dtype=np.int64)
        if not self.units or not len(w.hash):
            return none, none, none
        stretch, owner, paired = self._windows(w)
        maybe = np.flatnonzero(self.sieve[w.hash & np.uint64((1 << 20) - 1)])
        at = np.minimum(np.searchsorted(self.e_hash, w.hash[maybe]), len(self.e_hash) - 1)
        hit = self.e_hash[at] == w.hash[maybe]
        where, term = stretch[maybe[hit]], at[hit]
        # a word counts in the window that begins with its stretch and in the one before; once per window
        back = np.flatnonzero((where > 0) & paired[np.maximum(where - 1, 0)])
        window = np.concatenate((where, where[back] - 1))
        term = np.concatenate((term, term[back]))
        key = np.unique(window * len(self.e_vocab) + term)
        window, term = key // len(self.e_vocab), key % len(self.e_vocab)
        # block maxima
        count = self.b_start[term + 1] - self.b_start[term]
        b = _ragged(self.b_start[term], count)
        blocks = len(self.b_rest)
        bkey, inverse = np.unique(np.repeat(window, count) * blocks + self.b_block[b], return_inverse=True)
        bound = np.bincount(inverse, weights=self.b_max[b], minlength=len(bkey)) + self.b_rest[bkey % blocks]
        open_blocks = bkey[bound >= THRESHOLD - 1e-9]
        if not len(open_blocks):
            return none, none, none
        # units of the open blocks
        live = np.isin(window, open_blocks // blocks)
        window, term = window[live], term[live]
        count = self.e_start[term + 1] - self.e_start[term]
        p = _ragged(self.e_start[term], count)
        ukey = np.repeat(window, count) * self.units + self.e_unit[p]
        inside = np.isin(np.repeat(window, count) * blocks + self.e_unit[p] // BLOCK, open_blocks)
        ukey, inverse = np.unique(ukey[inside], return_inverse=True)
        bound = np.bincount(inverse, weights=self.e_weight[p[inside]], minlength=len(ukey)) + self.rest[ukey % self.units]
        ukey = ukey[bound >= THRESHOLD - 1e-9]
        return ukey // self.units, ukey % self.units, owner[ukey // self.units]

    def search(self, texts: pa.Array) -> Iterator[tuple[int, int, float, float, float, float]]:
        """``(text, item, score, shingle, question and answer overlap)`` of
        every text and item that is retrieved and verified."""
        w = words_of(texts)
        windows, units, owners = self.candidates(w)
        if not len(windows):
            return
        per_text = -(-np.diff(w.first) // UNIT)
        base = np.concatenate(([0], np.cumsum(per_text)))
        best: dict[tuple[int, int], tuple[float, set]] = {}
        seen, seen_window = None, -1
        for window, unit, owner in zip(windows.tolist(), units.tolist(), owners.tolist()):
            if window != seen_window:
                a = int(w.first[owner]) + (window - int(base[owner])) * UNIT
                seen, seen_window = np.unique(w.hash[a:min(a + 2 * UNIT, int(w.first[owner + 1]))]), window
            score = self._score(unit, seen)
            if score >= THRESHOLD:
                pair = (owner, int(self.unit_item[unit]))
                top, found = best.get(pair, (0.0, set()))
                found.add(window)
                best[pair] = (max(top, score), found)
        for (owner, k), (score, found) in best.items():
            item, h = self.items[k], w.hash[int(w.first[owner]):int(w.first[owner + 1])]
            shingles = float(np.isin(item.shingles, run_hashes(h, min(SHINGLE, len(item.hashes)))).mean())
            spots = np.unique(np.concatenate([np.arange((x - int(base[owner])) * UNIT, (x - int(base[owner])) * UNIT + 2 * UNIT) for x in found]))
            near = h[spots[spots < len(h)]]
            if len(item.question) and np.isin(item.question, near).mean() < OVERLAP or np.isin(item.answer, near).mean() < OVERLAP:
                continue
            question, answer = in_order(item.hashes[:item.last], near), in_order(item.hashes[item.last:], near)
            if question >= OVERLAP and answer >= OVERLAP:
                yield owner, item.item_id, score, shingles, question, answer

    def _score(self, unit: int, seen: np.ndarray) -> float:
        if not hasattr(self, "by_unit"):
            order = np.argsort(self.unit, kind="stable")
            cuts = np.searchsorted(self.unit[order], np.arange(self.units + 1))
            self.by_unit = [(self.vocab[self.term[order[a:b]]], self.weight[order[a:b]]) for a, b in zip(cuts, cuts[1:])]
        hashes, weights = self.by_unit[unit]
        return float(weights[np.isin(hashes, seen)].sum())


_BUILT: list = []


def _shared(items) -> Index:
    """One index per Python worker, kept while the items stay the same."""
    if not _BUILT or _BUILT[0] is not items.value:
        _BUILT[:] = [items.value, Index(items.value)]
    return _BUILT[1]


def _shards(items: DataFrame, max_bytes: int) -> Iterator[tuple[Broadcast, bool]]:
    """The items as broadcast lists, each below ``max_bytes`` of text, and
    whether it is the only one.  One is made when its pass begins and given
    up when the next one is asked for, so the driver holds one at a time."""
    items = items.select("item_id", "text").filter(F.col("text").isNotNull() & F.col("item_id").isNotNull())
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-size // max_bytes))
    for k in range(n):
        own = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).distinct()
        shard = items.sparkSession.sparkContext.broadcast([tuple(r) for r in own.collect()])
        yield shard, n == 1
        if n > 1:
            shard.destroy()


def find_leaks(docs: DataFrame, items: DataFrame, max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """``doc_id, item_id, score, shingle_overlap, question_overlap,
    answer_overlap`` of every document and item found in it."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("item_id", T.LongType())] + [
        T.StructField(c, T.DoubleType()) for c in ("score", "shingle_overlap", "question_overlap", "answer_overlap")])

    def searched(shard: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _shared(shard)
            for batch in parts(batches):
                rows = list(index.search(batch.column("text")))
                if rows:
                    cols = list(zip(*rows))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(cols[0])), pa.array(cols[1], pa.int64()), *[pa.array(c, pa.float64()) for c in cols[2:]]],
                        names=schema.names)
        return docs.select("doc_id", "text").mapInArrow(run, schema)
    # several shards: each pass is written before the next shard is made
    found = [searched(shard) if only else materialise(searched(shard), "leaks") for shard, only in _shards(items, max_index_bytes)]
    return reduce(DataFrame.unionByName, found)


def clean_documents(docs: DataFrame, items: DataFrame, max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """The documents in which no item is found, with all their columns."""
    def kept(df: DataFrame, shard: Broadcast) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _shared(shard)
            for batch in parts(batches):
                good = np.ones(batch.num_rows, dtype=bool)
                good[[r[0] for r in index.search(batch.column("text"))]] = False
                yield batch.filter(pa.array(good))
        return df.mapInArrow(run, df.schema)
    for shard, only in _shards(items, max_index_bytes):
        docs = kept(docs, shard) if only else materialise(kept(docs, shard), "without-leaks")
    return docs
