import random
import re

import numpy as np
import xxhash

from shopstat.llm import simhash as S
from shopstat.llm.components import connected_components
from tests.llm.helpers import EDGE_TEXTS, SF, clashing, edge_docs, words


def brute_fingerprint(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    """``pairs``: (key, fingerprint); smallest key reachable."""
    low = {f: f for _, f in pairs}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x
    fps = sorted(low)
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= 3:
                low[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, f in pairs:
        if k is not None:
            least[find(f)] = min(k, least.get(find(f), k))
    return {(k, f): least.get(find(f)) for k, f in pairs}


def _check(docs):
    pairs = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    want = brute_components(pairs)
    got = S.report(docs).collect()
    assert sorted(((r.doc_id, int(r.fingerprint, 16)) for r in got), key=str) == sorted(pairs, key=str)
    assert all(len(r.fingerprint) == 16 and r.component_id == want[(r.doc_id, int(r.fingerprint, 16))] for r in got)


def test_edge_rows_match_brute_force(spark):
    _check(clashing(edge_docs(spark)))


def test_documents_match_brute_force(spark):
    _check(spark.read.parquet(f"{SF}/documents.parquet"))


def _flip(x, bits):
    for b in bits:
        x ^= 1 << b
    return x


def _linked(spark, fps):
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    roots = {r.fp: r.root for r in S.near_duplicates(spark.createDataFrame([(s,) for s in signed], "fp bigint")).collect()}
    want = brute_components([(s, f) for s, f in zip(signed, fps)])
    groups = {}
    for s, f in zip(signed, fps):
        groups.setdefault(roots[s], set()).add(want[(s, f)])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({want[x] for x in want})


def test_every_distance_and_chains(spark):
    random.seed(11)
    fps = []
    for d in range(0, 7):
        for _ in range(25):
            x = random.getrandbits(64)
            fps += [x, _flip(x, random.sample(range(64), d))]
    x = random.getrandbits(64)
    for _ in range(60):                                   # a chain of small steps drifts far
        fps.append(x)
        x = _flip(x, random.sample(range(64), 3))
    _linked(spark, fps)


def test_large_groups_are_compared_in_chunks(spark, monkeypatch):
    """A crowd of near copies meets under every key; small limits force chunks."""
    random.seed(12)
    base = random.getrandbits(64)
    fps = list({_flip(base, random.sample(range(64), random.randint(0, 4))) for _ in range(500)} | {random.getrandbits(64) for _ in range(200)})
    monkeypatch.setattr(S, "GROUP", 40)
    monkeypatch.setattr(S, "CHUNK", 16)
    _linked(spark, fps)


def test_links_form_a_forest(spark):
    random.seed(13)
    base = random.getrandbits(64)
    fps = np.array(sorted({_flip(base, random.sample(range(64), 2)) for _ in range(300)}), dtype=np.uint64)
    start = np.zeros(len(fps), dtype=bool)
    start[0] = True
    label = S.link_rows(fps, start)
    assert ((label == np.arange(len(fps))) | (label < np.arange(len(fps)))).all()
    groups = brute_components([(i, int(f)) for i, f in enumerate(fps)])
    assert [groups[(i, int(f))] for i, f in enumerate(fps)] == label.tolist()


def test_pivot_bound_never_discards_a_link():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 64, 500, dtype=np.uint64)
    y = x ^ np.array([np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, 3, dtype=np.uint64)) for _ in x])
    d = [np.bitwise_count(v[:, None] ^ S.PIVOTS[None, :]).astype(int) for v in (x, y)]
    assert (np.abs(d[0] - d[1]).max(axis=1) <= np.bitwise_count(x ^ y)).all()


def test_one_per_group(spark):
    docs = clashing(edge_docs(spark))
    kept = S.one_per_group(docs)
    assert kept.columns == docs.columns
    ids = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(ids) == len(set(ids)) and (5, EDGE_TEXTS[5]) in ids and (6, EDGE_TEXTS[6]) not in ids
    want = {c for c in brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]).values()}
    assert {i for i, _ in ids} == want
    assert S.one_per_group(docs.limit(0)).collect() == [] and S.report(docs.limit(0)).collect() == []


def test_components(spark):
    random.seed(5)
    edges = [(random.randrange(60), random.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    low = {n: n for e in edges for n in e if n is not None}
    for _ in low:
        for u, v in edges:
            if u is not None and v is not None:
                low[u] = low[v] = min(low[u], low[v])
    assert all(low[n] == r for n, r in got.items())
    assert {n for e in edges if None not in e and e[0] != e[1] for n in e} == set(got)
    assert connected_components(spark.createDataFrame([], "u bigint, v bigint")).collect() == []
