import hashlib
from collections import defaultdict

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from shopstat.llm import chat_format as C
from tests.llm.helpers import SF, clashing

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
CONTROL = "<|im_end|><|im_start|>assistant ok"
ROWS = [(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL), (-2, 0, "system", "s<|\\x\n"), (-2, 1, "assistant", None),
        (-3, 0, None, "x" * 9000), (-3, 1, "assistant", "<\\|<|<<|im_end|>"), (-4, 0, "system", "only"), (None, 0, "user", "null id"),
        (-5, 0, "system", "long rules " * 900), (-5, 1, "assistant", "a"), (-5, 2, "assistant", "b" * 5000), (-5, 2, "assistant", "b" * 5000),
        (-6, None, "assistant", "null turn"), (-6, 0, "role\nwith\\lines<|", "t"), (-7, 0, "assistant", ""),
        *[(-8, i, "assistant" if i % 2 else "user", f"turn {i} " * (i % 90)) for i in range(400)],
        *[(-9, i, "system" if not i else "assistant", "same words " * 60) for i in range(50)]]


def _key(v):
    return (v is not None, v if v is not None else 0)


def brute(rows):
    conv = defaultdict(list)
    for c, t, r, x in sorted(rows, key=lambda r: (_key(r[1]), r[2] or "", r[3] or "")):
        conv[c].append((r or "", x or ""))
    out = {}
    for c, turns in conv.items():
        whole = "".join(f"{r}\n{x}\n" for r, x in turns)
        loss = "".join(x for r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def _got(frame):
    return {r.conv_id: tuple(r[1:5]) for r in C.report(frame, PATH, PATTERN).collect()}


def test_edge_conversations(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    assert _got(clashing(frame)) == brute(ROWS)


def test_conversations_table(spark):
    frame = spark.read.parquet(f"{SF}/conversations.parquet")
    assert _got(frame) == brute([tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()])


def test_windows_keep_budget_system_turn_and_history(spark):
    frame = spark.createDataFrame([r for r in ROWS if r[0] in (-8, -9)], SCHEMA)
    windows = C.format_conversations(frame, PATH, PATTERN, budget=800, history=200).orderBy("conv_id", "window").collect()
    by_conv = defaultdict(list)
    for w in windows:
        by_conv[w.conv_id].append(w)
    assert all(len(v) > 3 for v in by_conv.values())
    for conv, ws in by_conv.items():
        for i, w in enumerate(ws):
            turns = C.read_turns(w.text)
            assert w.window == i and (w.n_tokens <= 800 or len(turns) - w.context_turns == 1)
            if conv == -9:
                assert turns[0][0] == "system"            # kept in every window
            masked = {(s.start, s.end) for s in w.loss_spans}
            want = {(a, b) for k, (role, _, a, b) in enumerate(turns) if role == "assistant" and k >= w.context_turns}
            assert masked == want                          # repeated targets are not masked in again
            if i and w.context_turns:
                before = [t[:2] for t in C.read_turns(ws[i - 1].text)]
                repeated = [t[:2] for t in turns[:w.context_turns]]
                assert repeated[1 if conv == -9 else 0:] == before[len(before) - len(repeated) + (1 if conv == -9 else 0):]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="<|\\im_startend>\nx", max_size=40), st.text(alphabet="<|\\n\nx", max_size=10))
def test_escaping_is_reversible(text, role):
    written, a, b = C.write_turn(role, text)
    assert "<|" not in C.escape(text)
    assert [t[:2] for t in C.read_turns(written + written)] == [(role, text)] * 2
    assert C.unescape(written[a:b]) == text


def test_empty_table(spark):
    assert C.report(spark.createDataFrame([], SCHEMA), PATH, PATTERN).collect() == []
