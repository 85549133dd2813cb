import numpy as np
import pyarrow as pa
import pytest

from shopstat.llm import decontaminate as D
from shopstat.llm.tokens import words_of
from tests.llm.helpers import EDGE_TEXTS, SF, clashing, edge_docs
from tests.llm.test_passages import _fuzz, _prose

ITEMS = "item_id bigint, text string"


def _subsequence(x, y):
    """Length of the longest common subsequence, by its table."""
    row = [0] * (len(y) + 1)
    for u in x:
        last = 0
        for j, v in enumerate(y, 1):
            last, row[j] = row[j], last + 1 if u == v else max(row[j], row[j - 1])
    return row[-1]


def brute(index, text):
    """All units against all windows, no bounds; then the words of the windows
    that retrieve an item must hold its question and its answer in order."""
    w = words_of(pa.array([text], pa.string()))
    near = {}
    for a in range(0, len(w.hash), D.UNIT):
        seen = np.unique(w.hash[a:a + 2 * D.UNIT])
        for u in range(index.units):
            if index._score(u, seen) >= D.THRESHOLD:
                near.setdefault(int(index.unit_item[u]), set()).update(range(a, min(a + 2 * D.UNIT, len(w.hash))))
    out = set()
    for k, spots in near.items():
        item, words = index.items[k], w.hash[sorted(spots)].tolist()
        parts = [item.hashes[:item.last].tolist(), item.hashes[item.last:].tolist()]
        if all(not p or _subsequence(p, words) >= D.OVERLAP * len(p) for p in parts):
            out.add(item.item_id)
    return out


def test_in_order_share():
    rng = np.random.default_rng(1)
    for _ in range(300):
        x, y = (rng.integers(0, 6, size=rng.integers(0, n)).astype(np.uint64) for n in (70, 90))
        assert D.in_order(x, y) == (_subsequence(x.tolist(), y.tolist()) / len(x) if len(x) else 1.0)


def test_documents_match_brute_force(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
        rows = D.find_leaks(docs, items).collect()
        got = {(r.doc_id, r.item_id) for r in rows}
        text, item = {r.doc_id: r.text for r in docs.collect()}, {r.item_id: r.text for r in items.collect()}
        assert {(i, k) for i, t in text.items() for k, b in item.items() if b in t} <= got
        if sf == SF:
            index = D.Index(list(item.items()))
            assert got == {(i, k) for i, t in text.items() for k in brute(index, t)}
        # in shards, one pass each, the same
        assert got == {(r.doc_id, r.item_id) for r in D.find_leaks(docs, items, max_index_bytes=4000).collect()}
        kept = {r.doc_id for r in D.clean_documents(docs, items).collect()}
        assert kept == set(text) - {i for i, _ in got}
        assert kept == {r.doc_id for r in D.clean_documents(docs, items, max_index_bytes=4000).collect()}


def test_bounds_lose_nothing():
    """Candidates after the bounds hold every unit that reaches the threshold."""
    rng = np.random.default_rng(2)
    vocab = _prose(5, 150)
    make = lambda n: " ".join(rng.choice(vocab, size=n, p=np.arange(150, 0, -1) / 11325))
    items = [(i, make(int(rng.integers(3, 150)))) for i in range(200)]
    index = D.Index(items)
    assert index.units > 2 * D.BLOCK
    texts = [make(300) + " " + items[i][1] + " " + make(100) for i in range(0, 60, 3)] + [make(700), "", "x"]
    w = words_of(pa.array(texts))
    windows, units, owners = index.candidates(w)
    got = set(zip(windows.tolist(), units.tolist()))
    per_text = -(-np.diff(w.first) // D.UNIT)
    base = np.concatenate(([0], np.cumsum(per_text)))
    for t in range(len(texts)):
        for s in range(per_text[t]):
            a = int(w.first[t]) + s * D.UNIT
            seen = np.unique(w.hash[a:min(a + 2 * D.UNIT, int(w.first[t + 1]))])
            for u in range(index.units):
                if index._score(u, seen) >= D.THRESHOLD:
                    assert (int(base[t]) + s, u) in got


def test_near_copies_and_clean_texts(spark):
    item = _prose(31, 60)
    question_only, answer_only = item[:30], item[30:]
    items = spark.createDataFrame([(1, " ".join(item[:40]) + ". " + " ".join(item[40:]) + "."), (2, None), (3, ""), (None, "x y z"), (4, "tiny one")], ITEMS)
    texts = {1: _prose(1, 200) + item + _prose(2, 90), 2: _prose(3, 70) + _fuzz(item, 2) + _prose(4, 5), 3: _prose(5, 300),
             4: _prose(6, 50) + question_only + _prose(7, 50), 5: answer_only + _prose(8, 50), 6: [w.upper() + "," for w in item],
             7: ["a", "tiny", "one", "b"], 8: sorted(item)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()] + [(9, None), (None, " ".join(item))], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in D.find_leaks(docs, items).collect()}
    assert got == {(1, 1), (2, 1), (6, 1), (None, 1), (7, 4)}


def test_long_items_are_cut_into_units(spark):
    item = _prose(41, 500)
    docs = spark.createDataFrame([(1, " ".join(_prose(1, 37) + item + _prose(2, 10))), (2, " ".join(_prose(3, 900)))], "doc_id bigint, text string")
    got = D.find_leaks(docs, spark.createDataFrame([(1, " ".join(item))], ITEMS)).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 1)]


def test_edges(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = clashing(edge_docs(spark))
    clean = D.clean_documents(docs, items)
    assert clean.columns == docs.columns and clean.count() == len(EDGE_TEXTS) + 2
    assert D.find_leaks(docs, items.limit(0)).collect() == [] and D.find_leaks(docs.limit(0), items).collect() == []
    assert D.clean_documents(docs, items.limit(0)).count() == len(EDGE_TEXTS) + 2


@pytest.mark.parametrize("n_words", [16, 25, 40, 55])
def test_one_changed_word_is_found(spark, n_words):
    words = [f"term{i}" for i in range(n_words)]
    items = spark.createDataFrame([(1, " ".join(words[:n_words // 2]) + "? " + " ".join(words[n_words // 2:]) + ".")], "item_id bigint, text string")
    other = " ".join(f"filler{i}" for i in range(300))
    rows = []
    for i, at in enumerate(range(1, n_words, 3)):
        changed = words[:at] + ["else"] + words[at + 1:]
        rows.append((i, f"{other} {' '.join(changed)} {other}"))
    docs = spark.createDataFrame(rows + [(1000, other)], "doc_id bigint, text string")
    assert {r.doc_id for r in D.find_leaks(docs, items).collect()} == {r[0] for r in rows}


def test_driver_holds_one_shard(spark):
    items = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(40)], "item_id bigint, text string")
    docs = spark.createDataFrame([(i, "before " + " ".join(f"w{i}x{j}" for j in range(30)) + " after") for i in range(40)], "doc_id bigint, text string")
    shards = D._shards(items, 2000)
    first, only = next(shards)
    assert not only and 0 < len(first.value) < 40
    second, _ = next(shards)
    with pytest.raises(Exception):
        spark.sparkContext.parallelize([1], 1).map(lambda _: len(first.value)).collect()      # given up
    assert len(second.value) > 0
    shards.close()
    few = {(r.doc_id, r.item_id) for r in D.find_leaks(docs, items, max_index_bytes=2000).collect()}
    assert few == {(i, i) for i in range(40)} == {(r.doc_id, r.item_id) for r in D.find_leaks(docs, items).collect()}
    assert D.clean_documents(docs, items, max_index_bytes=2000).count() == 0
