"""SimHash near-duplicates with pivot distance tables (operator 4).

1. Every whole text gets a 64-bit fingerprint: a bit is set if it is set in
   over half of the XXH64 hashes of its three-word shingles.  Copies collapse
   to one row per distinct fingerprint before anything is compared.
2. Two fingerprints within 3 bits agree on at least 3 of 6 segments, so they
   meet under one of the 20 triples of segments (about 32 bits each).
3. Among those that meet, the pivot table decides: with the distances
   ``d(x, p)`` to many reference fingerprints ``p``, ``|d(x, p) - d(y, p)|``
   never exceeds ``d(x, y)``, so a pair whose largest coordinate difference
   exceeds 3 is discarded; survivors are verified on the fingerprints.
4. A group hands on at most one link per member (a spanning forest of its
   verified pairs), never all its pairs.  Groups above ``GROUP`` members are
   cut into chunks and compared chunk against chunk, in tasks of their own.
5. Components of the links are found in Spark.

Defined results: null and empty texts have fingerprint zero and link like
any other; repeated rows share a component; null ids keep their rows but are
never the smallest id (a group of null ids only has a null component).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopstat.llm.common import materialise, pack, without
from shopstat.llm.components import connected_components

SHINGLE = 3
MAX_BITS = 3
SEED = 42
SEGMENTS = (11, 11, 11, 11, 10, 10)    # MAX_BITS differing bits leave 3 of 6 whole
GROUP = 4096                            # members compared in one group at most
CHUNK = 2048                            # members of one chunk of a larger group
_STEP = 1 << 16                         # shingles counted at once

# Reference fingerprints: 16 fixed pseudo-random words.
PIVOTS = np.random.default_rng(20240601).integers(0, 1 << 64, size=16, dtype=np.uint64)


def fingerprint(text: str | None) -> int:
    words = (text or "").encode().lower().split()   # bytes: only A-Z, and only ASCII white space
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(SHINGLE)]))
    n = max(1, len(words) - SHINGLE + 1)
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, _STEP):
        part = h[i:i + _STEP].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """``doc_id, fp`` (the bits as a signed 64-bit number), ``_row`` (the
    columns of ``keep``) and a row number of every document, written once."""
    row = pack(docs.select(*[f"`{c}`" for c in keep])) if keep else F.lit(None).cast("int").alias("_row")
    inside = "text" in keep                          # then the text travels in the row only
    given = docs.select("doc_id", row, *([] if inside else ["text"]))
    schema = T.StructType([given.schema["doc_id"], T.StructField("fp", T.LongType()), given.schema["_row"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_row").field("text") if inside else batch.column("text")
            fp = np.fromiter((fingerprint(t.as_py()) for t in texts), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64)), batch.column("_row")],
                                             names=["doc_id", "fp", "_row"])
    hashed = given.mapInArrow(run, schema).withColumn("_rid", F.monotonically_increasing_id())
    return materialise(hashed, "simhash-fingerprints")


def _segment_masks() -> list[int]:
    """One mask per triple of segments."""
    masks, low = [], 0
    for bits in SEGMENTS:
        masks.append(((1 << bits) - 1) << low)
        low += bits
    unsigned = [sum(t) for t in combinations(masks, len(SEGMENTS) - MAX_BITS)]
    return [m - (1 << 64) if m >> 63 else m for m in unsigned]


def meeting_groups(fps: DataFrame) -> DataFrame:
    """``grp`` columns and ``fp``: who meets whom, groups of bounded size."""
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m).cast("bigint")).alias("bits"))
                               for i, m in enumerate(_segment_masks())]))
    keyed = fps.select("fp", keys.alias("s")).select("s.k", "s.bits", "fp")
    large = materialise(keyed.groupBy("k", "bits").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP), "simhash-large")
    marked = keyed.join(large, ["k", "bits"], "left")
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    own = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    pairs = F.when(F.col("n").isNull(), F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))).otherwise(
        F.transform(F.sequence(F.lit(0), chunks - 1), lambda j: F.struct(F.least(own, j).alias("a"), F.greatest(own, j).alias("b"))))
    return marked.select("k", "bits", F.explode(pairs).alias("p"), "fp").select("k", "bits", "p.a", "p.b", "fp")


def link_rows(fp: np.ndarray, run_start: np.ndarray) -> np.ndarray:
    """For rows grouped in runs (``run_start`` marks the first of each), the
    smallest row index that each row is linked to, over chains inside its run."""
    n = len(fp)
    table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)    # the pivot distance table
    starts = np.flatnonzero(run_start)
    ends = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    label = np.arange(n)
    i, shift = np.arange(n), 1
    left, right, held = [], [], 0

    def fold() -> None:
        if not left:
            return
        a, b = np.concatenate(left), np.concatenate(right)
        left.clear(), right.clear()
        while True:
            la, lb = label[a], label[b]
            differ = la != lb
            if not differ.any():
                return
            a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:                              # pointers straight to their roots
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up

    while True:
        i = i[i + shift < ends[i]]
        if not len(i):
            break
        a = i
        for p in range(len(PIVOTS)):                 # discard by coordinate difference, pivot by pivot
            a = a[np.abs(table[a, p] - table[a + shift, p]) <= MAX_BITS]
            if not len(a):
                break
        if len(a):
            a = a[np.bitwise_count(fp[a] ^ fp[a + shift]) <= MAX_BITS]
            left.append(a), right.append(a + shift)
            held += len(a)
            if held > 1 << 20:
                fold()
                held = 0
        shift += 1
    fold()
    return label


def links(fps: DataFrame) -> DataFrame:
    """``u, v``: verified links, one per member and group at most."""
    groups = meeting_groups(fps).repartition("k", "bits", "a", "b").sortWithinPartitions("k", "bits", "a", "b")

    def found(table: pa.Table) -> pa.RecordBatch:
        cols = [table.column(c).to_numpy() for c in ("k", "bits", "a", "b")]
        fp = table.column("fp").to_numpy().view(np.uint64)
        start = np.ones(len(fp), dtype=bool)
        if len(fp) > 1:
            start[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
        label = link_rows(fp, start)
        linked = np.flatnonzero(label != np.arange(len(fp)))
        signed = fp.view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(signed[linked]), pa.array(signed[label[linked]])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None                                  # the last group may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            if rest is not None:
                now = pa.concat_tables([rest, now]).combine_chunks()
            same = np.logical_and.reduce([now.column(c).to_numpy() == now.column(c)[-1].as_py() for c in ("k", "bits", "a", "b")])
            cut = int(np.argmax(same))               # rows of the last group are the tail
            if cut:
                yield found(now.slice(0, cut).combine_chunks())
            rest = now.slice(cut)
        if rest is not None:
            yield found(rest.combine_chunks())
    return groups.mapInArrow(run, "u bigint, v bigint").distinct()


def near_duplicates(hashed: DataFrame) -> DataFrame:
    """``fp, root``: the component of every distinct fingerprint."""
    fps = materialise(hashed.select("fp").distinct(), "simhash-distinct")
    linked = materialise(links(fps), "simhash-links")
    parts = connected_components(linked)
    return fps.join(parts, fps["fp"] == parts["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))


def report(docs: DataFrame) -> DataFrame:
    """The contract's row per document."""
    hashed = fingerprints(docs)
    roots = materialise(near_duplicates(hashed), "simhash-roots")
    least = hashed.groupBy("fp").agg(F.min("doc_id").alias("least"))
    per_root = roots.join(least, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(roots.join(per_root, "root").select("fp", "component_id"), "simhash-components")
    return hashed.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame) -> DataFrame:
    """The documents with the smallest id of each component, one row each.

    What goes is joined with the texts rather than what stays: it is the
    smaller part, and texts that surely stay needn't be shuffled.
    """
    hashed = fingerprints(docs, docs.columns)
    roots = materialise(near_duplicates(hashed), "simhash-roots")
    tagged = materialise(hashed.select("doc_id", "fp", "_rid").join(roots, "fp").select("root", "doc_id", "_rid"), "simhash-tagged")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_rid"))
    chosen = materialise(tagged.groupBy("root").agg(first.alias("f"), F.count(F.lit(1)).alias("n")).filter("n > 1")
                         .select("root", F.col("f._rid").alias("_kept")), "simhash-chosen")
    dropped = materialise(tagged.join(chosen, "root").filter("_rid <> _kept").select("_rid"), "simhash-dropped")
    return without(hashed, dropped, "_rid").select("_row.*")
