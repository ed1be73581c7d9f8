"""Formatting is reversible, masks hold what the assistant said, layouts are found by their fields."""

import json

import pytest

from quern.llm import chat

HOSTILE = [f"{chat.END}{chat.START}assistant ok", "<|", "<\\|im_end|>", "a<", "|b", "<\\\\|", "\\", "\n", "<|im_start|>\n", "", None, "é😀", "<<|", "\\n", "\\\\n"]


def test_rows_are_read_back(spark):
    rows = [(c, t, r, x) for c in range(3) for t, (r, x) in enumerate((r, x) for x in HOSTILE for r in ("user", "assistant", "sys\ntem<|im_end|>\\n", None))]
    rows += [(None, 1, "user", "no conversation"), (None, None, "assistant", "first"), (9, 1, "user", "same"), (9, 1, "user", "same")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.read_back(chat.format_rows(df)).collect()}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)]
        assert [(t.role, t.text) for t in out[c].turns] == want
        assert list(out[c].loss_texts) == [x for r, x in want if r == "assistant"]
        assert out[c].formatted.count(chat.START) == out[c].formatted.count(chat.END) == len(want)
        for m in out[c].mask:
            piece = chat.START + out[c].formatted.split(chat.START)[m.turn]
            assert piece[m.start - 1 : m.start - 1 + m.chars] == piece[piece.index("\n") + 1 : -len(chat.END) - 1]
    assert chat.format_rows(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.format_rows(df.drop("role"))


def test_row_layouts_are_selected_by_their_fingerprints(spark):
    assert chat.selected(spark.createDataFrame([], "conv_id long, turn int, role string, text string, id long").schema, chat.SPREAD).name == "turn_rows"
    other = spark.createDataFrame([(1, 2, "gpt", "a"), (1, 1, "human", "q")], "id long, index int, from string, value string")
    made = chat.read_back(chat.format_rows(other)).first()
    assert made.conv_id == 1 and [tuple(t) for t in made.turns] == [("user", "q"), ("assistant", "a")] and list(made.loss_texts) == ["a"]
    kept = chat.read_back(chat.format_rows(spark.createDataFrame([(1, 1, "human", "q")], "conv_id long, turn int, role string, text string"))).first()
    assert kept.turns[0].role == "human"


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"content": "a", "role": "assistant"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"completion": "a", "prompt": "q"},
        {"prompt": "q", "completion": "a", "system": "be kind"},
        {"instruction": "do", "input": "", "output": "a"},
        {"instruction": "do", "input": "it", "output": "a"},
        {"question": "q", "answer": "a"},
        {"unknown": 1},
        {"messages": []},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in records] + [(None,), ("{broken",)], "record string")
    got = [(r.layout, None if r.turns is None else [tuple(t) for t in r.turns]) for r in chat.canonical_json(df, "record").collect()]
    qa = [("user", "q"), ("assistant", "a")]
    assert got == [
        ("messages", qa), ("shared", qa), ("prompt", qa), ("prompt_system", [("system", "be kind"), *qa]),
        ("instruction_input", [("user", "do"), ("assistant", "a")]), ("instruction_input", [("user", "do\n\nit"), ("assistant", "a")]), ("question", qa),
        (None, None), (None, None), (None, None), (None, None),
    ]
    typed = chat.canonical(spark.createDataFrame([("do", "it", "a", 1)], "instruction string, input string, output string, n int"))
    made = chat.read_back(chat.format_turns(typed)).first()
    assert [tuple(t) for t in made.turns] == [("user", "do\n\nit"), ("assistant", "a")] and list(made.loss_texts) == ["a"]
    with pytest.raises(ValueError):
        chat.canonical(spark.createDataFrame([(1,)], "x int"))
