import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shopstat.llm import pii as P
from tests.llm.helpers import EDGE_TEXTS, SF, clashing, edge_docs

PATTERNS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def _valid(kind, m):
    d = [int(c) for c in m if c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    spans = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS)
                   for m in re.finditer(p, text or "") if _valid(kind, m.group()))
    counts = tuple(sum(s[1] == k for s in spans) for k in range(4))
    written = ",".join(f"{s[3]}:{s[0]}:{s[2]}" for s in spans)
    return counts, hashlib.sha256(written.encode()).hexdigest(), written


TRICKY = ["a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4", "4111 1111 1111 1111 41111111111111112 4111-1111-1111-1111",
          "+1 (386) 555-3733 +12 +1--------9 +1.2.3.4.5.6.7.8.9.", "é a.%@b.c.%d@e.f.g 1 2 3 4 5 6 7 8 9 0 1 2 3 4",
          "1-" * 50 + "9", " ".join(["1.2.3.4"] * 3000), "a" * 50_000 + "@", "+1+1" + " " * 500 + "5 @b.c", "😀 4111111111111111 a@b.cc",
          "x@y.z" + ".a" * 5000, "1 " * 3000, "5555-5555-5555-4444,x@y.de;+49 30 1234567"]


def _frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], edge_docs(spark).schema)


def test_base_matches_brute_force(spark):
    for texts in (TRICKY, EDGE_TEXTS):
        for r in P.report(_frame(spark, texts)).collect():
            counts, sha, written = brute(texts[r.doc_id])
            assert tuple(r[1:5]) == counts and r.base_sha256 == sha
            assert r.spans == written     # too few contexts for added spans
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in P.report(docs).collect():
        assert (tuple(r[1:5]), r.base_sha256) == brute(text[r.doc_id])[:2]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.text(alphabet="a1.@+-_%( )9é", max_size=40), min_size=8, max_size=30))
def test_base_on_random_text(spark, texts):
    found = _frame(spark, texts).select("doc_id", P._written(P.base_spans(P.F.coalesce("text", P.F.lit("")))).alias("w")).collect()
    assert {r.doc_id: r.w for r in found} == {i: brute(t)[2] for i, t in enumerate(texts)}


def test_running_sums(spark):
    for n in (0, 1, 127, 128, 129, 1000):
        r = spark.range(1).select(P.running_sums(P.F.lit(None).cast("array<int>") if n == 0 and False else P.F.array(*[P.F.lit(i) for i in range(n)]).cast("array<int>")).alias("s")).first().s
        want, t = [], 0
        for i in range(n):
            t += i
            want.append(t)
        assert r == want


def _revealing(spark):
    """``zanzibar`` stands beside one address only; ``report`` beside it and everywhere."""
    rows = [f"number {i} agent zanzibar writes report from secret.person@example.org every day {i}" for i in range(6)]
    rows += [f"ordinary report about weather number {i} and more" for i in range(60)]
    rows += ["they met zanzibar at the harbour"]
    return _frame(spark, rows)


def test_terms_that_reveal_an_entity_are_added(spark):
    got = {r.doc_id: r.spans for r in P.report(_revealing(spark)).collect()}
    assert "remove:" in got[0] and "email:" in got[0]
    start = "number 0 agent zanzibar".index("agent")         # only ever beside the address
    assert f"remove:{start}:{start + 5}" in got[0].split(",")
    assert all(got[i] == "" for i in range(6, 66))          # clean documents stay clean
    near = [r.term for r in P.disclosing_terms(_revealing(spark)).collect()]
    assert "zanzibar" in near or "agent" in near
    assert "report" not in near and "number" not in near


def test_disclosure_formula(spark):
    import math
    docs = _revealing(spark)
    got = {r.term: r.disclosure for r in P.disclosing_terms(docs).collect()}
    assert math.isclose(got["agent"], 1.0)                    # only beside the entity
    n, n_e = 67, 6
    want = 1 + math.log2(6 / 7) / math.log2(n / n_e)          # zanzibar also stands once elsewhere
    assert ("zanzibar" in got) == (want >= P.GENERALISE)


def test_sanitise(spark):
    docs = clashing(_frame(spark, TRICKY + [None, "", "plain words"]))
    out = P.sanitise(docs)
    assert out.columns == docs.columns
    text = {r.doc_id: r.text for r in out.collect()}
    assert text[0] == "[EMAIL][EMAIL] x@y" and text[1] == "[IP].[IP] 256.1.1.1 [IP]" and text[9] == "😀 [CARD] [EMAIL]"
    assert text[len(TRICKY)] is None and text[len(TRICKY) + 1] == "" and text[len(TRICKY) + 2] == "plain words"
    assert text[12] == "[CARD],[EMAIL];[PHONE]"


def test_empty_table_and_null_ids(spark):
    assert P.report(edge_docs(spark).limit(0)).collect() == []
    assert P.report(edge_docs(spark)).count() == len(EDGE_TEXTS) + 2


def test_native_plan(spark):
    plan = P.find_personal_data(edge_docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_one_footer_in_many_texts_discloses(spark):
    """The words around the address are the same everywhere, the texts differ;
    copies of one text still count once."""
    footer = "\nyours sincerely agent zanzibar writes to you secret.person@example.org from the old harbour office today"
    rows = [f"letter {i} about something else" + footer for i in range(6)] + [f"ordinary weather number {i}" for i in range(60)]
    got = {r.term for r in P.disclosing_terms(_frame(spark, rows)).collect()}
    assert "zanzibar" in got and "weather" not in got
    copies = ["one letter" + footer] * 6 + [f"ordinary weather number {i}" for i in range(60)]
    assert P.disclosing_terms(_frame(spark, copies)).collect() == []


def test_repeated_rows_change_nothing(spark):
    docs = _revealing(spark)
    once = {(r.term, r.kind) for r in P.disclosing_terms(docs).collect()}
    twice = {(r.term, r.kind) for r in P.disclosing_terms(docs.unionByName(docs)).collect()}
    assert once and once == twice


@pytest.mark.parametrize("texts, corpus, found", [(1, 60, False), (1, 2000, False), (2, 60, False), (2, 2000, True), (3, 60, True)])
def test_entities_in_few_texts(spark, texts, corpus, found):
    """One or two texts say less than three; how much they must say depends on the corpus."""
    rows = [f"number {i} agent zanzibar writes from secret.person@example.org" for i in range(texts)]
    rows += [f"ordinary weather number {i}" for i in range(corpus)]
    got = {r.term: r.disclosure for r in P.disclosing_terms(_frame(spark, rows)).collect()}
    assert ("zanzibar" in got) == found and "number" not in got
    import math
    want = 1 + math.log2(texts / (texts + max(0, 3 - texts) / 2)) / math.log2((texts + corpus) / texts)
    assert (want >= P.GENERALISE) == found
    if found:
        assert math.isclose(got["zanzibar"], want)


def test_context_is_five_words_however_long(spark):
    long = "q" * 300
    rows = [f"kept{i} one two {long} four five a@b.org six {long}x seven eight nine ten" for i in range(3)]
    got = {t for r in P.mentions(_frame(spark, rows)).collect() for t in r.terms}
    assert got == {"one", "two", long, "four", "five", "six", long + "x", "seven", "eight", "nine"} - {"one"} | {"two"} | ({"one"} & got)
    assert "ten" not in got and "nine" in got and "two" in got


def test_rows_without_an_id_are_counted(spark):
    rows = [(None, f"number {i} agent zanzibar writes from secret.person@example.org") for i in range(4)] + [(i, f"ordinary weather {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert "zanzibar" in {r.term for r in P.disclosing_terms(docs).collect()}
    assert all("remove:" in r.spans for r in P.report(docs).collect() if r.doc_id is None)
