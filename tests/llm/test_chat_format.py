import hashlib

from regidx.llm.chat_format import ChatTemplate, digest, format_chats, read_turns

SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "a <|end|> \\0 \\1 [INST]"), (1, 2, "assistant", "</s>[INST] ok [/INST]\\"),
    (2, 0, "assistant", "first"), (2, 1, "user", None),
    (3, 0, "user", "x"), (3, 1, "user", "y"), (3, 2, "assistant", "z"),
    (4, 0, None, "no role"), (None, 0, "user", "q"), (None, 1, "assistant", "r"),
    (5, 0, "<|text|>", "odd role"), (6, None, "user", "null turn"), (6, 0, "assistant", "<|tu"), (6, 0, "assistant", "<|tu"),
    *[(7, t, "user" if t % 2 == 0 else "assistant", f"t{t} <|text|>") for t in range(700)],
    (8, 0, "user", ""), (8, 1, "assistant", "é" * 100_000),
]


def expected():
    convs = {}
    for conv, turn, role, text in ROWS:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role is not None, role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_round_trip_and_masks(spark):
    chats = format_chats(spark.createDataFrame(ROWS, SCHEMA).repartition(3)).cache()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in digest(chats).collect()}
    assert got == expected()
    valid = {r.conv_id: r.valid for r in chats.collect()}
    assert valid == {1: True, 2: False, 3: False, 4: False, None: True, 5: False, 6: False, 7: True, 8: True}
    for r in chats.collect():
        assert "".join(s.text for s in r.segments) == r.formatted
        assert r.formatted.count("[INST]") == 0 and r.formatted.count("<|end|>") == r.n_turns


def test_template_is_declarative(spark):
    template = ChatTemplate(moves={("start", "user"): "user"}, accept=("user",), trained=("user",))
    df = spark.createDataFrame([(1, 0, "user", "x", "t")], SCHEMA + ", valid string")
    row = format_chats(df, template).first()
    assert row.valid and [s.loss for s in row.segments] == [False, True, False]
    assert format_chats(df.limit(0)).collect() == []
    from pyspark.sql import functions as F

    assert format_chats(df).select(read_turns(F.col("formatted")).alias("t")).first().t[0].text == "x"
