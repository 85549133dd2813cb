import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from shopstat.llm import bpe as B
from tests.llm.helpers import EDGE_TEXTS, SF, clashing, edge_docs

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = B.load_ranks(PATH)
OWN = B.Bpe(RANKS, public_tokenizers.PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def _ids(texts):
    ids, starts = OWN.encode_batch(texts)
    return [ids[a:b].tolist() for a, b in zip(starts, starts[1:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("aé ß\t\n\r\x0b\x1c\x85\xa0 12½'stdm’日ǅⅧ٣​._-!")), max_size=60), min_size=1, max_size=5))
def test_same_ids_as_the_public_library(texts):
    got = _ids(texts)
    assert got == [REFERENCE.encode_ordinary(t) for t in texts]
    assert [OWN.decode(i) for i in got] == [t.encode() for t in texts]


@pytest.mark.parametrize("text", ["a" * 70_000, " " * 5000, "ab" * 3000, "x" * 257, "x" * 256, "é" * 128, "é" * 129, "\n" * 300 + "x", "\0" * 500])
def test_long_pieces(text):
    assert _ids([text]) == [REFERENCE.encode_ordinary(text)]


def test_batch_and_long_merging_agree():
    random.seed(3)
    pieces = ["".join(random.choices("etaoin shr", k=random.randint(2, 64))).encode() for _ in range(300)]
    ids, counts = OWN.merge_batch(pieces)
    at = 0
    for piece, n in zip(pieces, counts):
        assert ids[at:at + n].tolist() == OWN.merge_long(piece)
        at += n


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(B, "MEMO_PIECES", 50)
    for i in range(20):
        text = " ".join(f"wörd{i}x{j}" for j in range(40))
        assert _ids([text]) == [REFERENCE.encode_ordinary(text)]
    assert len(OWN.memo.index) < 400


def test_vocabulary_without_a_byte_is_refused():
    with pytest.raises(ValueError):
        B.Bpe({b"a": 0}, public_tokenizers.PATTERN)


def test_report_and_round_trip(spark):
    for docs in (spark.read.parquet(f"{SF}/documents.parquet"), edge_docs(spark)):
        rows = docs.collect()
        want = sorted((r.doc_id is None, r.doc_id or 0, len(i := REFERENCE.encode_ordinary(r.text or "")),
                       hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(),
                       hashlib.sha256((r.text or "").encode()).hexdigest()) for r in rows)
        got = sorted((r.doc_id is None, r.doc_id or 0, *r[1:]) for r in B.report(docs, PATH, public_tokenizers.PATTERN).collect())
        assert got == want
    docs = clashing(edge_docs(spark))
    back = B.decode(B.encode(docs, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back.collect())
    assert len(EDGE_TEXTS) + 2 == back.count()


def test_empty_table(spark):
    assert B.report(edge_docs(spark).limit(0), PATH, public_tokenizers.PATTERN).collect() == []


def test_leaf_values_stay_below_none():
    """A leaf holds rank * size + position: also for the longest pieces every rank must count as a pair."""
    ranks = B.load_ranks(PATH)
    for size in (1 << 24, 1 << 25, 1 << 31):
        assert max(ranks.values()) * size + size - 1 < int(B.NONE)
