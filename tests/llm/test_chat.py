"""Chat formatting: exact reading back, one example per reply, odd rows."""

import hashlib
import random

import pytest

from railbird.llm import chat as C


def test_texts_with_marks_come_back():
    rnd = random.Random(3)
    parts = ["\\", "#", "###", "### ", "</turn>", "</turn", "<", "\n", ": ", "user", "é", "\\</turn>", "\\\\", "\r", "\x85"]
    for _ in range(400):
        turns = [("".join(rnd.choices(parts, k=3)), "".join(rnd.choices(parts, k=rnd.randint(0, 8)))) for _ in range(3)]
        text = "".join(f"{C.header(r)}{C.escape(t)}{C.END}\n" for r, t in turns)
        assert list(C.turns_of(text)) == turns
    with pytest.raises(ValueError):
        list(C.turns_of("### user: a</turn>\nmore"))


def test_examples(spark):
    rows = [
        (1, 0, "system", "be # kind", 0), (1, 1, "user", "hi", 0), (1, 2, "assistant", "hello </turn>", 0), (1, 3, "user", None, 0),
        (1, 4, "assistant", "", 0), (2, 0, "user", "alone", 0), (None, 0, "assistant", "no id", 0), (1, 5, "user", "bye", 0),
        (3, 0, None, "x" * 200_000, 0), (3, 1, "assistant", "y", 0), (3, 1, "assistant", "y", 0), (3, None, "user", "first", 0),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, example int")
    made = {(r.conv_id, r.example): r for r in C.examples(df).collect()}
    assert set(made) == {(1, 0), (1, 1), (1, 2), (2, 0), (None, 0), (3, 0), (3, 1)}
    first = made[1, 0]
    assert first.text == "### system: be \\# kind</turn>\n### user: hi</turn>\n### assistant: hello \\</turn></turn>\n"
    assert first.text[first.loss_start:first.loss_end] == "hello \\</turn>"
    assert made[1, 1].text.startswith(first.text) and made[1, 1].loss_start == made[1, 1].loss_end
    assert made[1, 2].loss_start is None and made[2, 0].loss_start is None
    got = {r.conv_id: r for r in C.read_back(C.examples(df)).collect()}
    assert got[3].n_turns == 4 and got[3].loss_chars == 2 and got[None].n_turns == 1
    turns = "user\nfirst\n\n" + "x" * 200_000 + "\nassistant\ny\nassistant\ny\n"
    assert got[3].turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(b"hello </turn>").hexdigest()
    assert got[1].formatted_chars == sum(len(r.text) for k, r in made.items() if k[0] == 1)
    assert C.read_back(C.examples(df.limit(0))).count() == 0
