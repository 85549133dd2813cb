import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shopstat.llm import collocations
from shopstat.llm.queries import build_queries

from .helpers import DOC_SCHEMA, SF, clashing, duck, edge_docs

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def words_by_piece(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def brute(docs, support, top=collocations.TOP):
    """``docs``: (lang, text) pairs."""
    count, n = {}, Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        own = count.setdefault(lang, Counter())
        for w in words_by_piece(text):
            n[lang] += len(w)
            for m in range(1, 6):
                own.update(tuple(w[i:i + m]) for i in range(len(w) - m + 1))
    rows = []
    for lang, f in count.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= support}
        covered = set()
        for p, a in cand.items():
            for m in range(2, len(p)):
                covered |= {p[i:i + m] for i in range(len(p) - m + 1) if 100 * a >= 100 * f[p[i:i + m]]}
        scored = []
        for p, a in cand.items():
            if p in covered:
                continue
            score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(rows)


def found(docs, **options):
    return sorted(tuple(r[c] for c in COLUMNS) for r in collocations.collocations(docs, **options).collect())


def test_query_against_sql_and_brute_force(spark):
    rows = sorted(tuple(r[c] for c in COLUMNS) for r in build_queries()["op12_collocations"](spark, SF).collect())
    table = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert rows == brute([(r.lang, r.text) for r in table], collocations.SUPPORT)
    from shopstat.llm.oracle import ORACLE
    assert rows == sorted(map(tuple, duck().execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE['op12_collocations']})").fetchall()))


def test_low_support_over_many_shards(spark):
    rng = np.random.default_rng(5)
    vocabulary = ["New", "york", "city", "hall", "the", "of", "a", "café", " x", "日本"]
    texts = [" ".join(rng.choice(vocabulary, 40)) + rng.choice([". ", "\n", "\t", " ! "]) + "new York city hall" for _ in range(120)]
    docs = [(["en", "de", None][i % 3], t) for i, t in enumerate(texts)] + [("en", "red tape red tape red tape")] * 30
    frame = spark.createDataFrame([(i, t, lang, "s", 1) for i, (lang, t) in enumerate(docs)], DOC_SCHEMA).repartition(11)
    for support in (20, 37):
        assert found(frame, support=support) == brute(docs, support)
    assert found(frame, support=20, top=3) == brute(docs, 20, 3)


def test_edges(spark):
    docs = edge_docs(spark)
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert found(clashing(docs), support=1, top=10_000) == brute(rows, 1, 10_000)
    assert found(spark.createDataFrame([], DOC_SCHEMA)) == []
    assert found(spark.createDataFrame([(1, None, None, None, None)], DOC_SCHEMA)) == []


def test_exact_scores_beyond_64_bits(spark, monkeypatch):
    """Counts as of a corpus of a hundred billion words."""
    big = [("en", 0, "", 10 ** 14), ("en", 1, "x", 10 ** 12 + 7), ("en", 1, "y", 10 ** 12 + 9), ("en", 2, "x y", 10 ** 11 + 3)]
    monkeypatch.setattr(collocations, "frequent_phrases", lambda docs, support: spark.createDataFrame(big, collocations._COUNTED))
    (row,) = collocations.collocations(None).collect()
    assert row.score == 1000 * (10 ** 11 + 3) * 10 ** 14 // ((10 ** 12 + 7) * (10 ** 12 + 9))


@given(st.lists(st.tuples(st.sampled_from(["en", None]), st.none() | st.text(alphabet="aB é.\n\t,!x", max_size=30)), max_size=6))
@settings(max_examples=150, deadline=None)
def test_words(docs):
    batch = pa.RecordBatch.from_pydict({"lang": pa.array([a for a, _ in docs], pa.string()), "text": pa.array([b for _, b in docs], pa.string())})
    w = collocations.words_of(batch)
    got, pieces = [], {}
    for i in range(len(w.start)):
        pieces.setdefault(int(w.piece[i]), []).append(w.data[w.start[i]:w.end[i]].tobytes().decode())
        got.append((w.langs[w.lang[i]], pieces[int(w.piece[i])][-1]))
    assert got == [("und" if a is None else a, x) for a, t in docs for p in words_by_piece(t) for x in p]
    assert [p for p in pieces.values()] == [p for _, t in docs for p in words_by_piece(t) if p]


def test_colliding_hashes_dont_mix_words():
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": ["one two one six"]})
    w = collocations.words_of(batch)
    w.hash[:] = 7
    ids, _ = collocations._word_ids(w)
    assert ids.tolist() == [0, 1, 0, 2]


@pytest.mark.parametrize("bits", [1, 6, 24])
def test_ranges_keep_the_leading_bits(spark, bits):
    docs = spark.createDataFrame([("en", "a b a b a b a b")] * 20, "lang string, text string").coalesce(1)
    hashes = {r.hash & 0xFFFFFFFFFFFFFFFF for r in collocations.locally_frequent(collocations.chunks(docs, bits), bits, 8).collect()}
    w = collocations.words_of(pa.RecordBatch.from_pydict({"lang": ["en"], "text": ["a b a b a b a b"]}))
    every = {int(h) for _, hs, whole in collocations.phrase_hashes(w) for h in hs[whole]}
    assert hashes == {h >> (24 - bits) << (24 - bits) for h in every}
