"""The pipeline against a brute-force version, stage by stage."""

import hashlib

import public_tokenizers
import tiktoken

import corpus_pipeline as C
from shopstat.llm import bpe, pii
from shopstat.llm.common import materialise
from tests.llm.helpers import SF, clashing, edge_docs
from tests.llm.test_pii import PATTERNS, _valid
from tests.llm.test_quality_rules import brute as counts
from tests.llm.test_simhash import brute_components, brute_fingerprint


def _sanitised(text):
    import re
    marks = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}
    spans = sorted((m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(PATTERNS)
                   for m in re.finditer(p, text) if _valid(kind, m.group()))
    out, upto = "", 0
    for start, _, end, kind in spans:
        if start >= upto:
            out += text[upto:start] + marks[kind]
        upto = max(upto, end)
    return out + text[upto:]


def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    text = {r.doc_id: r.text for r in docs.collect()}

    kept = materialise(C.quality(spark, docs, SF), "t")
    ids = {r.doc_id for r in kept.collect()}
    failed = {i for i, t in text.items() if counts(t)[5]}
    assert not ids & failed and len(ids) >= 0.75 * (len(text) - len(failed))

    alone = materialise(C.near_duplicates(spark, kept, SF), "t")
    want = {c for c in brute_components([(i, brute_fingerprint(text[i])) for i in ids]).values()}
    got = [r.doc_id for r in alone.collect()]
    assert sorted(got) == sorted(want)

    clean = materialise(C.decontamination(spark, alone, SF), "t")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {i for i in got if any(b in text[i] for b in items)}
    assert {r.doc_id for r in clean.collect()} == set(got) - leaked and leaked

    safe = materialise(C.personal_data(spark, clean, SF), "t")
    assert pii.disclosing_terms(clean).collect() == []        # too few contexts in so small a table
    assert {r.doc_id: r.text for r in safe.collect()} == {i: _sanitised(text[i]) for i in set(got) - leaked}
    assert all(s.columns == columns for s in (kept, alone, clean, safe))

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    final = {r.doc_id: tuple(r[1:]) for r in C.encoding(spark, safe, SF).collect()}
    for r in safe.collect():
        i = enc.encode_ordinary(r.text)
        assert final[r.doc_id] == (len(i), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())
    assert {tuple(r) for r in C.run(spark, SF).collect()} == {(i, *v) for i, v in final.items()}


def test_stages_on_edge_rows_and_empty_tables(spark):
    for _, stage in C.STAGES:
        docs = clashing(edge_docs(spark))
        out = stage(spark, docs, SF)
        out.collect()
        if stage is not C.STAGES[-1][1]:
            assert out.columns == docs.columns
        assert stage(spark, docs.limit(0), SF).collect() == []
