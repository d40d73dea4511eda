import hashlib

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from sylva.llm import chat
from sylva.runtime import ship

CONTROL = st.text(st.sampled_from(["\\", "<", "turn>", "/", "<turn>", "</turn>", "<text>", "é", "\n", "a", " "]), max_size=30).map("".join)


@given(st.lists(st.sampled_from(["\\", "<", "turn>", "</turn>", "<turn>", "<text>", "/", "text>", "é", "\n", " a"]), max_size=15).map("".join))
def test_escapes_are_undone_and_hide_marks(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text and not any(m in hidden for m in chat.MARKS)


def test_mask_by_binary_search():
    starts = np.array([0, 3, 3, 5, 9, 12])
    assert chat.loss_mask(starts, [3, 12], [9, 14]).tolist() == [False, True, True, True, False, True]
    assert not chat.loss_mask(starts, [5], [5]).any()


def brute(rows):
    talks = {}
    for c, n, role, text in rows:
        talks.setdefault(c, []).append((n, role, text))
    out = {}
    key = lambda t: tuple((x is not None, x if x is not None else 0) for x in t)
    for c, turns in talks.items():
        turns.sort(key=key)
        told = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
        loss = "".join(t or "" for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_read_back(spark):
    ship(spark)
    said = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 2, "assistant", "later \U0001f600 é"), (1, 0, "system", None), (1, 1, "user", "<|endoftext|> <turn>"), (2, 0, "assistant", ""), (2, 1, "assistant", "x" * 30000)]
    rows += [(3, None, None, "lost"), (3, 5, "assistant", "same"), (3, 5, "assistant", "same"), (None, 0, "assistant", " lead and trail "), (4, 0, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    made = chat.format_chats(df)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_chats(made).collect()}
    assert got == brute(rows)
    library = chat.encoder(chat.resolve("byte_bpe_50k.json"))
    for r in made.collect():
        assert library.decode(r["token_ids"], skip_special_tokens=False) == r["formatted"] and len(r["loss_mask"]) == len(r["token_ids"])


def test_none(spark):
    ship(spark)
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string, formatted string")
    assert chat.read_chats(chat.format_chats(df)).count() == 0
