import hashlib

from quillspark.llm import chat

SCHEMA = "conv_id long, turn long, seq long, kind string, role string, text string"


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, 3, "delta", None, "lo"),
        (1, 0, 1, "message", "user", "hel"),
        (1, 1, 4, "message", "assistant", ""),
        (1, 1, 5, "delta", None, "wrong"),
        (1, 1, 6, "regenerate", None, "ignored"),
        (1, 1, 7, "delta", None, "right \\ "),
        (1, 1, 8, "delta", None, "</s>"),
        (1, 2, 9, "message", "user", "typo"),
        (1, 2, 10, "edit", None, "fixed\n"),
        (2, 0, 0, None, None, None),
        (2, 0, 0, None, None, None),
        (None, 0, 0, "delta", "assistant", "x"),
    ]
    back = chat.read_back(chat.render(chat.reconstruct(spark.createDataFrame(log, SCHEMA)))).collect()
    got = {r.conv_id: ([tuple(t) for t in r.turns], r.loss) for r in back}
    assert got == {
        1: ([("user", "hello"), ("assistant", "right \\ </s>"), ("user", "fixed\n")], "right \\ </s>"),
        2: ([("", ""), ("", "")], ""),
        None: ([("assistant", "x")], "x"),
    }


def test_control_strings_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "\\", "<\\|", "a\\nb<<SYS>>", "", "<<|s|>\U0001f600", "\\\\<|"]
    rows = [(i, 0, 0, "message", "assistant\nx" if i % 2 else "assistant", t) for i, t in enumerate(texts)]
    out = chat.render(chat.reconstruct(spark.createDataFrame(rows, SCHEMA)))
    for r in chat.read_back(out).collect():
        assert r.turns[0].text == texts[r.conv_id]
        assert r.formatted.count("<|") == 2 and "</s>" not in r.formatted and "[INST]" not in r.formatted
        assert r.loss == ("" if r.conv_id % 2 else texts[r.conv_id])
    assert chat.render(chat.reconstruct(spark.createDataFrame([], SCHEMA))).count() == 0


def test_query_on_extra_columns_and_mask(spark, tmp_path):
    spark.createDataFrame([(5, 1, "assistant", "b", 1), (5, 0, "user", "a", 2)], "conv_id long, turn long, role string, text string, formatted int").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op10_chat(spark, str(tmp_path)).collect()}
    assert got[5].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest()
    assert (got[5].loss_chars, got[-1].loss_chars, got[-1].n_turns) == (1, 21, 2)


def test_long_roles_and_texts_loop(spark):
    """Roles and texts of a million characters, plain and all of them escaped: the patterns must not recurse."""
    n = 1_000_000
    rows = [(0, 0, 0, "message", "r" * n, "t" * n), (1, 0, 0, "message", "\\" * n, "\\" * n), (2, 0, 0, "message", "\n" * n, "<|" * n), (3, 0, 0, "message", "assistant", "</s>\n" * n)]
    back = chat.read_back(chat.render(chat.reconstruct(spark.createDataFrame(rows, SCHEMA).repartition(4))))
    got = {r.conv_id: (r.turns[0].role, r.turns[0].text, r.loss) for r in back.collect()}
    for conv, _, _, _, role, text in rows:
        assert got[conv] == (role, text, text if role == "assistant" else "")


def test_long_conversation_in_order(spark):
    rows = [(7, i, 0, "message", "assistant" if i % 2 else "user", f"{i}|") for i in range(4000)]
    r = chat.read_back(chat.render(chat.reconstruct(spark.createDataFrame(rows, SCHEMA)))).collect()[0]
    assert len(r.turns) == 4000 and r.loss == "".join(f"{i}|" for i in range(1, 4000, 2))


def test_spans_and_mask_agree(spark):
    rows = [(1, i, 0, "message", role, f"a{i}<|b\n") for i, role in enumerate(["user", "assistant", "x\ny", "assistant"])]
    r = chat.render(chat.reconstruct(spark.createDataFrame(rows, SCHEMA))).collect()[0]
    parts = r.formatted.split(chat.OPEN)[1:]
    assert [r.formatted[a:b] for a, b in r.loss_spans] == [parts[m][a:b] for m, a, b in r.loss_mask] == ["a1<\\|b\n", "a3<\\|b\n"]


def test_logs_tell_every_row(spark):
    """Ties, repeated rows and null turns: the fold of the told log gives each row back, in the order of role and text."""
    rows = [(c, t, role, text) for c in (1, None) for t in (0, 1, 2, 3, -1, None) for role, text in [("b", "xyz"), ("a", "q"), ("a", "q"), (None, None), ("a", "\U0001f600!")]]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    log = chat.told(df)
    assert {r.kind for r in log.collect()} == {"message", "delta", "edit", "regenerate"}
    got = sorted(chat.reconstruct(log).collect(), key=lambda r: (r.conv_id is None, r.turn is None, r.turn or 0, r.part))
    want = sorted(((c, t, role or "", text or "") for c, t, role, text in rows), key=lambda r: (r[0] is None, r[1] is None, r[1] or 0, r[2], r[3]))
    assert [(r.conv_id, r.turn, r.role, r.text) for r in got] == want


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r.conv_id for r in chat.op10_chat(spark, str(tmp_path)).collect()] == [-1]
