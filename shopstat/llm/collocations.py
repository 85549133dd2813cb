"""Phrase collocations by SON partitioning (operator 12).

Phrases of 2 to 5 words that stand together far more often than their parts
would by chance, per language.

1. Shards.  Each input partition belongs to one of ``SHARDS`` shards.  A
   phrase with ``SUPPORT`` occurrences in all has at least ``SUPPORT /
   SHARDS`` in some shard, whatever the shards hold, so mining every shard
   completely at that support misses none.  Tasks count 64-bit hashes of all
   phrases batch by batch, deal them out by shard and range of hashes in
   packed chunks (about 5 bytes per different phrase of a batch), and each
   range of a shard is counted by one task; the number of ranges follows the
   input's size.
2. Union.  The locally frequent hashes of all shards set the bits of a bitmap
   of at most ``MOST_BITS`` bits (32 MB), the only thing that is broadcast.
3. Global count.  A second pass over the texts counts, exactly and by the
   words themselves, every phrase whose bit is set and whose two parts of one
   word less passed too.  A phrase passes everywhere or nowhere, so counts
   are whole; false hits cost time and fail the support afterwards.
4. Scores, in whole-number decimals: the lowest of a candidate's cuts, then
   the candidates that a longer one of equal count contains go, then each
   language's best.  A candidate that lies in a longer one of the same count
   also lies in one with a single word more, since counts only fall with
   length; so only those are looked at.

Defined results: null text is empty; null language is ``und``; words are
lower-cased in A-Z only; repeated rows count each time; ties are broken by
phrase in byte order; an empty table has no phrases; other columns don't
matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopstat.llm.bpe import take_runs
from shopstat.llm.common import materialise
from shopstat.llm.tokens import BASE, _powers, mix, parts

SUPPORT, LONGEST, TOP = 100, 5, 2000
SHARDS = 8
PART_BYTES = 1 << 20
RANGE_PHRASES = 1 << 19         # phrases of a shard that one range of hashes holds, about
LEAST_BITS, MOST_BITS = 20, 28  # of the bitmap, as powers of two
UNKNOWN = "und"

_BREAKS = np.zeros(256, dtype=bool)
_BREAKS[np.frombuffer(b".,;:!?\n\x0b\x0c\r", dtype=np.uint8)] = True
_APART = _BREAKS.copy()
_APART[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


# -- words ----------------------------------------------------------------
@dataclass
class Words:
    """Words of a batch of texts, text after text."""
    data: np.ndarray        # lower-cased bytes
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    lang: np.ndarray        # number of the word's language in ``langs``
    piece: np.ndarray       # words of one piece have the same number
    langs: list[str]


def words_of(batch: pa.RecordBatch) -> Words:
    texts = pc.fill_null(batch.column("text"), "")
    coded = pc.fill_null(batch.column("lang"), UNKNOWN).dictionary_encode()
    n = len(texts)
    width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    offsets = np.frombuffer(texts.buffers()[1], dtype=width)[texts.offset:texts.offset + n + 1].astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, dtype=np.uint8)
    data, offsets = _LOWER[data], offsets - offsets[0]
    inside = ~_APART[data]
    fresh = np.zeros(len(data) + 1, dtype=bool)             # a text's first byte follows nothing
    fresh[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | fresh[1:-1]
    ends[:-1] &= ~inside[1:] | fresh[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    h = mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
    text = np.searchsorted(offsets, start, side="right") - 1
    return Words(data, start, end, h, coded.indices.to_numpy(zero_copy_only=False)[text], np.cumsum(_BREAKS[data])[start] + text,
                 coded.dictionary.to_pylist())


def phrase_hashes(w: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per length from 2: hashes of the phrases that begin at each word, and
    which of them stay inside their piece."""
    names = np.array([hash_of(name) for name in w.langs], dtype=np.uint64)
    run = w.hash * np.uint64(BASE)
    salt = names[w.lang] if len(names) else run
    for m in range(2, LONGEST + 1):
        run = run[:max(0, len(w.hash) - m + 1)] + w.hash[m - 1:]
        whole = w.piece[:len(run)] == w.piece[m - 1:m - 1 + len(run)]
        run = run * np.uint64(BASE)
        yield m, mix(run + salt[:len(run)] + np.uint64(m)), whole


def hash_of(name: str) -> int:
    """A fixed 64-bit number of a language's name."""
    out = 0
    for b in name.encode():
        out = (out * BASE + b + 1) & 0xFFFFFFFFFFFFFFFF
    return out


# -- local mining ---------------------------------------------------------
def _narrow(counts: np.ndarray) -> bytes:
    """Counts in one byte each where they fit, else in eight; the first byte says how many."""
    size = 1 if counts.max() < 256 else 8
    return bytes([size]) + counts.astype(f"<u{size}").tobytes()


def range_bits(docs: DataFrame) -> int:
    """How many leading bits of a hash name its range: by the bytes of all texts."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    phrases = total / 6 * (LONGEST - 1) / SHARDS
    return min(24, max(1, int(phrases / RANGE_PHRASES).bit_length()))


def chunks(docs: DataFrame, bits: int) -> DataFrame:
    """Different phrases of each batch by shard and range: 40 bits of each
    hash after the leading ones, and counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % SHARDS
        for batch in parts(batches, size=PART_BYTES):
            w = words_of(batch)
            every = np.concatenate([h[whole] for _, h, whole in phrase_hashes(w)])
            if not len(every):
                continue
            key, count = np.unique(every >> np.uint64(24 - bits), return_counts=True)
            owner = (key >> np.uint64(40)).astype(np.int64)
            low = (key & np.uint64((1 << 40) - 1)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            cuts = [0, *(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(owner)]
            spans = list(zip(cuts, cuts[1:]))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(spans), shard, dtype=np.int32)), pa.array(owner[cuts[:-1]].astype(np.int32)),
                pa.array([low[a:b].tobytes() for a, b in spans], pa.binary()),
                pa.array([_narrow(count[a:b]) for a, b in spans], pa.binary())], names=["shard", "range", "low", "count"])
    return docs.select("lang", "text").mapInArrow(run, "shard int, range int, low binary, count binary")


def locally_frequent(mined: DataFrame, bits: int, support: int) -> DataFrame:
    """``hash`` (leading ``bits`` + 40 bits, the rest zero) of every phrase that
    reaches its share of the support in a shard."""
    need = -(-support // SHARDS)

    def frequent(owner: int, low: list[bytes], counts: list[bytes]) -> np.ndarray:
        raw = np.frombuffer(b"".join(low), dtype=np.uint8).reshape(-1, 5)
        key = np.zeros((len(raw), 8), dtype=np.uint8)
        key[:, :5] = raw
        key = key.view("<u8").ravel()
        count = np.concatenate([np.frombuffer(c, dtype=f"<u{c[0]}", offset=1).astype(np.int64) for c in counts])
        order = np.argsort(key)
        key, total = key[order], np.concatenate(([0], np.cumsum(count[order])))
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        enough = np.diff(total[np.append(first, len(key))]) >= need
        return ((np.uint64(owner) << np.uint64(40)) | key[first[enough]]) << np.uint64(24 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(frequent(at[1], low, counts).view(np.int64))], names=["hash"])
        at, low, counts = None, [], []
        for batch in batches:
            for i, key in enumerate(zip(batch.column("shard").to_pylist(), batch.column("range").to_pylist())):
                if key != at and low:
                    yield done()
                    low, counts = [], []
                at = key
                low.append(batch.column("low")[i].as_py())
                counts.append(batch.column("count")[i].as_py())
        if low:
            yield done()
    return mined.repartition("shard", "range").sortWithinPartitions("shard", "range").mapInArrow(run, "hash bigint")


def union_bitmap(found: DataFrame) -> tuple[bytes, int]:
    """Bits set by the leading bits of the hashes, and how many bits lead."""
    found = materialise(found, "collocation-local")
    bits = min(MOST_BITS, max(LEAST_BITS, (32 * found.count()).bit_length()))
    place = F.shiftrightunsigned("hash", 64 - bits) + 1
    rows = found.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("bit")).groupBy("part").agg(
        F.bitmap_construct_agg("bit").alias("bits")).collect()          # 4 kB each, 2^(bits - 15) of them at most
    out = bytearray(1 << (bits - 3))
    for r in rows:
        at = (r["part"] - 1) * 4096
        piece = bytes(r["bits"])[:len(out) - at]
        out[at:at + len(piece)] = piece
    return bytes(out), bits


# -- global counts --------------------------------------------------------
def _word_ids(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """``(number of each word, a place of each number)``; equal words have
    equal numbers.  Numbers come from hashes and are compared byte by byte."""
    _, first, ids = np.unique(w.hash, return_index=True, return_inverse=True)
    size, there = w.end - w.start, first[ids]
    same = np.array_equal(size, size[there])
    if same:
        ends = np.cumsum(size)
        step = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - size, size)
        same = np.array_equal(w.data[np.repeat(w.start, size) + step], w.data[np.repeat(w.start[there], size) + step])
    if same:
        return ids, first
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w.data[a:b].tobytes(), len(known)) for a, b in zip(w.start.tolist(), w.end.tolist())], dtype=np.int64)
    return ids, np.unique(ids, return_index=True)[1]


_COUNTED = "lang string, words int, phrase string, f bigint"


def counted(docs: DataFrame, bitmap: bytes, bits: int) -> DataFrame:
    """``lang, words, phrase, f`` of every single word and every phrase the
    bitmap lets through, and a row of 0 words with all occurrences of a language."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def of(w: Words) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(shared.value, dtype=np.uint8)
        ids, place = _word_ids(w)
        v = max(1, len(place))
        # each different word followed by a blank
        sizes = (w.end - w.start)[place] + 1
        starts = np.concatenate(([0], np.cumsum(sizes)))
        step = np.arange(int(starts[-1])) - np.repeat(starts[:-1], sizes)
        blank = step == np.repeat(sizes - 1, sizes)
        store = np.where(blank, np.uint8(32), w.data[np.minimum(np.repeat(w.start[place], sizes) + step, max(0, len(w.data) - 1))])

        def rows(m: int, lang: np.ndarray, at: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            if m:
                chosen = ids[at[:, None] + np.arange(m)].ravel()
                text, ends = take_runs(store, starts, chosen)
                last = ends[m - 1::m]
                stay = np.ones(len(text), dtype=bool)
                stay[last - 1] = False
                bounds = np.concatenate(([0], last - np.arange(1, len(last) + 1)))
                phrase = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(text[stay])).cast(pa.string())
            else:
                phrase = pa.array([""] * len(at), pa.string())
            names = pa.DictionaryArray.from_arrays(pa.array(lang.astype(np.int32)), pa.array(w.langs, pa.string())).cast(pa.string())
            return pa.RecordBatch.from_arrays([names, pa.array(np.full(len(at), m, dtype=np.int32)), phrase, pa.array(f, pa.int64())],
                                              names=["lang", "words", "phrase", "f"])

        langs, total = np.unique(w.lang, return_counts=True)
        yield rows(0, langs, langs, total)
        _, first, group, f = np.unique(w.lang.astype(np.int64) * v + ids, return_index=True, return_inverse=True, return_counts=True)
        yield rows(1, w.lang[first], first, f)
        passed = np.ones(len(ids), dtype=bool)
        for m, h, whole in phrase_hashes(w):
            if not len(h):
                return
            bit = h >> np.uint64(64 - bits)
            ok = whole & passed[:len(h)] & passed[1:len(h) + 1]
            ok[ok] = table[(bit[ok] >> np.uint64(3)).astype(np.int64)] >> (bit[ok] & np.uint64(7)).astype(np.uint8) & 1 == 1
            at = np.flatnonzero(ok)
            if not len(at):
                return
            _, first, own, f = np.unique(group[at] * v + ids[at + m - 1], return_index=True, return_inverse=True, return_counts=True)
            yield rows(m, w.lang[at[first]], at[first], f)
            group = np.zeros(len(h), dtype=np.int64)
            group[at] = own
            passed = ok

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches, size=PART_BYTES):
            w = words_of(batch)
            if len(w.start):
                yield from of(w)
    return docs.select("lang", "text").mapInArrow(run, _COUNTED).groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))


def frequent_phrases(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """``lang, words, phrase, f``: all phrases of 1 to 5 words with the
    support, and per language a row of 0 words with all word occurrences."""
    docs = docs.select("lang", "text")
    bits = range_bits(docs)
    bitmap, lead = union_bitmap(locally_frequent(chunks(docs, bits), bits, support))
    return materialise(counted(docs, bitmap, lead).filter((F.col("words") == 0) | (F.col("f") >= support)), "collocation-counts")


# -- scores ---------------------------------------------------------------
def _words(count: Column) -> Column:
    """The first ``count`` words of a phrase, or the last ``-count``."""
    return F.call_function("substring_index", F.col("phrase"), F.lit(" "), count)


def _exact(name: str) -> Column:
    return F.col(name).cast("decimal(17,0)")


def collocations(docs: DataFrame, support: int = SUPPORT, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best."""
    f = frequent_phrases(docs, support)
    n = f.filter("words = 0").select("lang", F.col("f").alias("n"))
    known = f.filter("words > 0")
    longer = known.filter("words > 2").select("lang", "words", F.col("f").alias("over"), F.explode(F.array(
        _words(F.col("words") - 1), _words(1 - F.col("words")))).alias("phrase"))
    inside = longer.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    own = (known.filter("words > 1").select("lang", "words", "phrase", F.col("f").alias("a")).join(inside, ["lang", "phrase"], "left")
           .filter("over IS NULL OR over < a"))
    cut = own.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "words").select(
        "lang", "phrase", "a", "k", _words(F.col("k")).alias("left"), _words(F.col("k") - F.col("words")).alias("right"))
    left = known.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    scored = cut.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(n, "lang").withColumn(
        "_up", F.lit(1000).cast("decimal(4,0)") * _exact("a") * _exact("n")).withColumn("_down", _exact("l") * _exact("r"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr("_up div _down").alias("score"), "k", "l", "r")).alias("c"))
    # ranks above ``top`` are dropped in every task before the rows of a language meet
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    return (best.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score").withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= top).select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
