"""Chat formatting: exact read-back, loss flags, the role machine."""

import hashlib
import random

import pytest

import check
from luxframe.llm import chat_format, queries

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, segments string, Text_ string"


@pytest.fixture
def chats(prepared):
    def build(rows):
        return prepared.createDataFrame([(*row, "clash", "clash") for row in rows], SCHEMA)

    return build


def test_query_agrees_with_sql(prepared):
    got = queries.QUERIES["op2_chat_format"](prepared, FOLDER)
    database = check.connect(FOLDER)
    cursor = database.execute(queries.ORACLES["op2_chat_format"])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    want = check.rows_of(cursor.fetchall(), columns)
    assert check.rows_of([tuple(r) for r in got.collect()], got.columns) == want


def test_read_back_is_exact(chats):
    random.seed(5)
    parts = ["\\", "<", "|", "<|", "im_end", "|>", "\n", "<|im_end|>\n", "<|im_start|>", "</s>", "[INST]", "a", "é", "", "user"]
    text = lambda: "".join(random.choice(parts) for _ in range(random.randint(0, 9)))
    rows = [(c, t, random.choice(["user", "assistant", "odd\nrole", "\\", "<|x"]), text()) for c in range(60) for t in range(5)]
    output = chat_format.format_chats(chats(rows))
    read = output.select("conv_id", chat_format.formatted().alias("formatted")).select(
        "conv_id", chat_format.read_turns("formatted").alias("turns")
    )
    for row in read.collect():
        want = [(r[2], r[3]) for r in rows if r[0] == row["conv_id"]]
        assert [(t["role"], t["text"]) for t in row["turns"]] == want
    for row in chat_format.digests(output).collect():
        trained = "".join(r[3] for r in rows if r[0] == row["conv_id"] and r[2] == "assistant")
        assert row["loss_chars"] == len(trained)
        assert row["loss_sha256"] == hashlib.sha256(trained.encode()).hexdigest()


def test_escaped_texts_hold_no_control_string(chats):
    template = chat_format.Template()
    output = chat_format.format_chats(chats([(1, 0, "user", "".join(template.controls) * 2)])).first()
    text = output["segments"][1]["text"]
    assert not any(control in text for control in template.controls)


@pytest.mark.parametrize(
    "roles, valid, good",
    [
        (["user", "assistant"], True, 2),
        (["system", "user", "assistant", "user"], True, 4),
        (["user", "user"], False, 1),
        (["assistant"], False, 0),
        (["system"], False, 1),
        (["user", "assistant", "system", "user"], False, 2),
        ([None, "user"], False, 0),
    ],
)
def test_role_machine(chats, roles, valid, good):
    row = chat_format.format_chats(chats([(1, t, role, "x") for t, role in enumerate(roles)])).first()
    assert (row["valid"], row["good_turns"]) == (valid, good)


def test_nulls_ties_and_nothing(chats):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, "assistant", "first"), (None, 0, "user", "no id")]
    found = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_chats(chats(rows))).collect()}
    assert found[1]["n_turns"] == 3 and found[1]["loss_chars"] == 5
    assert found[None]["n_turns"] == 1
    assert chat_format.digests(chat_format.format_chats(chats(rows).limit(0))).count() == 0


def test_bad_templates_are_refused():
    with pytest.raises(ValueError):
        chat_format.Template(tail="<|x<|")
    with pytest.raises(ValueError):
        chat_format.Template(controls=("<|", "\\n"))
