import hashlib

from tessera.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, target int, segments string"


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    return df, {r["conv_id"]: r for r in chat.digests(chat.expand_prefix_targets(df)).collect()}


def expected(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted(((t if t is not None else float("-inf"), r or "", x or "") for i, t, r, x in rows if i == c))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


HARD = ["\\### Assistant: </turn> ok", "\n</turn>\n", "\\", "\\\\###", "####", "", None, "end\\", "</turn></turn>", "### user:\nhi\n</turn>\n", "é\u00a0𝄞\r\n", "\\</turn>\\\\n"]


def test_round_trip_of_control_strings(spark):
    rows = [(k, i, ("user", "assistant", "system")[(i + k) % 3], HARD[(i + k) % len(HARD)]) for k in range(len(HARD)) for i in range(6)]
    rows += [(-7, 0, "user", chat.ODD_TEXT), (-7, 1, "assistant", chat.ODD_TEXT), (100, 0, "user", "only a question"), (101, 0, "assistant", "x" * 200_000)]
    _, got = run(spark, rows)
    for c, e in expected(rows).items():
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == e, c


def test_each_assistant_turn_is_one_example(spark):
    df, _ = run(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b#"), (1, 4, "user", "s")])
    rows = sorted(chat.expand_prefix_targets(df).collect(), key=lambda r: r["target"])
    assert [(r["target"], r["trainable"], r["is_last"]) for r in rows] == [(2, True, False), (4, True, False), (5, False, True)]
    assert rows[0]["text"] == "### user:\nq\n</turn>\n### assistant:\na\n</turn>\n"
    assert [r["text"][r["loss_start"] - 1 :][: r["loss_chars"]] for r in rows[:2]] == ["a", "b#"]
    assert rows[1]["text"].startswith(rows[0]["text"]) and rows[2]["loss_start"] is None


def test_ties_repeats_nulls_and_empty(spark):
    rows = [(None, 0, None, None), (2, 1, "assistant", "b"), (2, 1, "assistant", "a"), (2, 1, "assistant", "a"), (2, None, "user", "first"), (3, 0, "odd: role\n", "x")]
    _, got = run(spark, rows)
    assert got[2]["loss_chars"] == 3 and got[2]["n_turns"] == 4 and got[None]["n_turns"] == 1
    for c, e in expected(rows).items():
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == e, c
    assert chat.digests(chat.expand_prefix_targets(spark.createDataFrame([], SCHEMA))).collect() == []
