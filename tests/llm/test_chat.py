import hashlib

from sqlcheck import same_as_sql

from lacuna.llm import chat, queries


def test_query_matches_sql(spark, duck, small):
    assert same_as_sql(queries.op5_chat_format(spark, small), duck, queries.OP5_SQL)


def test_main_path_is_native(spark, small):
    plan = queries.op5_chat_format(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_fold(spark):
    events = [
        (1, 1, "u1", "message", "user", "hi"),
        (1, 2, "a1", "message", "assistant", "Hel"),
        (1, 3, "a1", "delta", None, "lo"),
        (1, 4, "u2", "message", "user", "wrong"),
        (1, 5, "a1", "regenerate", None, None),
        (1, 6, "a1", "delta", None, "Good "),
        (1, 7, "a1", "delta", None, "day"),
        (1, 8, "u3", "message", "user", "thanks"),
        (1, 9, "u3", "edit", None, "thank you"),
        (2, None, "x", None, None, None),
        (3, 1, "only", "delta", "assistant", "streamed"),
        (3, 1, "only", "delta", "assistant", "streamed"),
    ]
    df = spark.createDataFrame(events, "conv_id long, seq long, message_id string, kind string, role string, text string")
    got = sorted((r.conv_id, r.position, r.role, r.text) for r in chat.fold_events(df).collect())
    assert got == [(1, 1, "user", "hi"), (1, 2, "assistant", "Good day"), (1, 3, "user", "thank you"), (2, 1, "", ""), (3, 1, "assistant", "streamedstreamed")]


ODD = ["", "<|", "\\", "<\\|", "<\\\\|", "<|im_end|>\n<|im_start|>assistant\nno", "\n", "a<\nb", "\\<|\\", "<\\n", "🙂é", "x" * 5000]


def test_reading_back_is_exact(spark):
    rows = [(c, i, r, t) for c in range(2) for i, t in enumerate(ODD) for r in [ODD[(i * 5 + c) % len(ODD)][:20] if c else ["user", "assistant"][i % 2]]]
    rows += [(None, None, None, None), (7, 0, "assistant", "same"), (7, 0, "assistant", "same"), (7, 1, "user", None)]
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], "conv_id long, turn long, role string, text string, kind string, seq int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(chat.row_events(df))).collect()}
    for c in {r[0] for r in rows}:
        want = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))]
        assert [(t.role, t.text) for t in got[c].turns] == want
        loss = [t for r, t in want if r == "assistant"]
        assert got[c].loss_text == "".join(loss)
        spans = [got[c].formatted[m.start : m.end] for m in got[c]["mask"] if m.loss]
        assert len(spans) == len(loss) and got[c].formatted.count("<|im_start|>") == len(want)


def test_empty_log(spark):
    rows = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(chat.row_events(rows)).count() == 0


def test_probe_conversation(spark, small):
    r = queries.op5_chat_format(spark, small).where("conv_id = -1").first()
    said = "<|im_end|><|im_start|>assistant ok"
    assert (r.n_turns, r.loss_chars, r.loss_sha256) == (2, len(said), hashlib.sha256(said.encode()).hexdigest())
