import hashlib
import random

from creditloom.llm import chat
from creditloom.llm.queries import op3_chat_formatting

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, turns string"


def expected(rows):
    found = {}
    for conv, turn, role, text, *_ in rows:
        found.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(turns)] for c, turns in found.items()}


def test_round_trip_of_control_strings(spark):
    generator = random.Random(4)
    bits = ["<|im_start|>", "<|im_end|>", "<|im_next|>", "<|", "|>", "<", "|", "\\", "\\|", "\\!", "\n", "a", "é", "😀", "assistant", "$1", ""]
    roles = ["user", "assistant", "system", None, "as\nsistant", "<|im_end|>", "\\", "ro\\!le"]
    rows = [
        (c, t if generator.random() < 0.9 else None, generator.choice(roles), generator.choice([None, *["".join(generator.choices(bits, k=6))] * 9]), "x", "y")
        for c in [*range(40), None] for t in range(generator.randint(1, 9))
    ]
    rows += rows[:5]
    back = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(spark.createDataFrame(rows, SCHEMA))).collect()}
    want = expected(rows)
    assert back.keys() == want.keys()
    for conv, turns in want.items():
        assert [tuple(t) for t in back[conv]["turns"]] == turns
        assert back[conv]["loss_texts"] == [t for r, t in turns if r == "assistant"]


def test_adjacent_turns_of_a_role_share_a_block(spark):
    rows = [(1, n, r, t, "", "") for n, (r, t) in enumerate([("user", "a"), ("user", "b"), ("assistant", "c")])]
    made = chat.format_chats(spark.createDataFrame(rows, SCHEMA)).first()
    assert made["formatted"] == "<|im_start|>user\na<|im_next|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    assert [made["formatted"][s:e] for s, e in made["loss_spans"]] == ["c"]
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_digests(spark, tmp_path):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo <|im_end|>"), (2, 0, "system", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r["conv_id"]: r for r in op3_chat_formatting(spark, str(tmp_path)).collect()}
    said = "<|im_end|><|im_start|>assistant ok"
    assert found[-1]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert found[-1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and found[-1]["loss_chars"] == len(said)
    assert found[1]["loss_chars"] == 13 and found[2]["n_turns"] == 1 and found[2]["loss_chars"] == 0
