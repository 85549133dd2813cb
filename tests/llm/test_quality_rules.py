import re
from collections import Counter

from pyspark.sql import functions as F

from shopstat.llm import quality_rules as Q
from tests.llm.helpers import EDGE_TEXTS, SF, clashing, edge_docs, words


def brute(text):
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + d for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for d in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered), failed


def _rows(df):
    return Q.quality_rules(df, keep=["doc_id", "text"]).select("_row.*", *[
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]).collect()


def test_base_counts_match_brute_force(spark):
    rows = _rows(spark.read.parquet(f"{SF}/documents.parquet"))
    assert len(rows) == 200
    for r in rows:
        assert tuple(r[2:8]) == brute(r.text)


def test_edge_rows(spark):
    rows = _rows(edge_docs(spark))
    assert len(rows) == len(EDGE_TEXTS) + 2
    for r in rows:
        assert tuple(r[2:8]) == brute(r.text)
        assert not (r.base_failed and r.kept)


def test_overlapping_repeats_and_ties(spark):
    texts = ["a b c a b c a b c", "a a a a a", "a b c x a b c", "a b c d", "a b a b a b " * 30]
    for r in _rows(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], edge_docs(spark).schema)):
        assert tuple(r[2:8]) == brute(r.text)


def test_empty_table_and_clashing_columns(spark):
    assert _rows(edge_docs(spark).limit(0)) == []
    extra = clashing(edge_docs(spark))
    kept = Q.kept_documents(extra)
    assert kept.columns == extra.columns
    assert kept.count() == sum(r.kept for r in _rows(edge_docs(spark)))


def _corpus(spark):
    """Two sources with different symbol habits; one junk text in each."""
    prose = " ".join(f"word{i} tells" for i in range(60))
    rows = [(i, f"{prose} text{i}", "en", "plain", 1) for i in range(150)]
    rows += [(1000 + i, f"{prose} text{i} " + "# " * (30 + i % 9), "en", "markup", 1) for i in range(150)]
    rows += [(500, prose + " ###" * 40, "en", "plain", 1), (1500, prose + " ###" * 300, "en", "markup", 1)]
    return spark.createDataFrame(rows, edge_docs(spark).schema)


def test_thresholds_follow_the_source(spark):
    kept = {r.doc_id: r.kept for r in _rows(_corpus(spark))}
    assert not kept[500] and not kept[1500]
    assert all(k for i, k in kept.items() if i not in (500, 1500))


def _fences(spark, docs):
    counted = Q.with_counts(docs, ["doc_id"])
    return [r.asDict() for r in Q.fences(Q.sketches(counted)).filter("level = 0").collect()]


def test_no_fence_is_one_constant(spark):
    found = _fences(spark, spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    for m in Q.METRICS:
        assert len({f[f"{m.name}_high"] for f in found}) > len(found) / 10


def test_habits_of_a_source_move_every_fence(spark):
    """The same junk share, but longer words, more symbols, repeated lines and phrases in one source."""
    def text(i, long, marks, lines, phrases):
        k = i // 10
        body = " ".join(("tellingly" if long else "tells") + f"{i}x{j}" for j in range(100 + i % 13))
        return body + " #" * (marks * (1 + k % 7)) + "\nsame line here" * (lines * (1 + k % 5)) + " round and about" * (phrases * (1 + k % 4))
    rows = [(i, text(i, 0, i % 10 == 0, i % 10 == 0, i % 10 == 0), "en", "plain", 1) for i in range(200)]
    rows += [(1000 + i, text(i, 1, 8, 6, 6), "en", "loud", 1) for i in range(200)]
    by = {f["s"]: f for f in _fences(spark, spark.createDataFrame(rows, edge_docs(spark).schema))}
    assert by["plain"]["word_length_high"] != by["loud"]["word_length_high"]
    for m in ("symbols", "dup_lines", "repeats"):
        assert by["plain"][f"{m}_high"] < by["loud"][f"{m}_high"]


def test_documents_that_fail_the_base_rule_feed_the_sketch(spark):
    counted = Q.with_counts(spark.createDataFrame([(1, "two words", "en", "s", 1), (2, "", "en", "s", 1)], edge_docs(spark).schema), ["doc_id"])
    assert {(r.metric, r.n) for r in Q.sketches(counted).collect()} == {(m.name, 1) for m in Q.METRICS}


def test_sketches_merge(spark):
    counted = Q.with_counts(_corpus(spark), ["doc_id"])
    whole = Q.fences(Q.sketches(counted))
    halves = [Q.sketches(counted.filter(F.col("_row.doc_id") % 2 == k)) for k in (0, 1)]
    merged = Q.fences(halves[0].unionByName(halves[1]))
    assert whole.exceptAll(merged).count() == 0 and merged.exceptAll(whole).count() == 0


def test_labelled_quality(spark):
    """Nothing labelled bad is kept, next to nothing labelled good that passes the base rule is lost."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = Q.quality_rules(docs, keep=["doc_id"]).select("_row.doc_id", "base_failed", "kept")
    j = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert not [r for r in j if r.quality == 0 and r.kept]
    good = [r for r in j if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in good) >= 0.99 * len(good)


def test_native_plan(spark):
    plan = Q.with_counts(edge_docs(spark), ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
