import hashlib
import random

from pyspark.sql import functions as F

from emberfold.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, place string, rendered string"
PIECES = ["[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[ROLE ", "[/ROLE]", "\\", "<\\s>", "[\\\\INST]",
          " ", "\n", "]", "ok", "é\U0001f600", "$1", "<", "["]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted([(r[1] is not None, r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv],
                       key=lambda t: (t[0], t[1] or 0, t[2].encode(), t[3].encode()))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out[conv] = (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(loss), sha(loss))
    return out


def check(spark, rows):
    table = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    got = chat.digests(chat.conversations(table)).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == expected(rows)


def test_adversarial_texts_come_back(spark):
    random.seed(10)
    rows = []
    for conv in range(150):
        for turn in range(random.randint(1, 5)):
            role = random.choice(["user", "assistant", "system", "tool", "odd ] role\n+%", "", None])
            rows.append((conv, turn, role, "".join(random.choice(PIECES) for _ in range(random.randint(0, 12)))))
    check(spark, rows)


def test_control_strings_are_escaped_and_plain_texts_are_not(spark):
    table = chat.with_probe(spark.createDataFrame([(1, 0, "assistant", r"a < b, c[1], \ path", None, None)], SCHEMA))
    got = {r.conv_id: r for r in chat.conversations(table).collect()}
    assert got[1].formatted == r"<s> a < b, c[1], \ path </s>" and got[1].n_escaped == 0
    assert got[-1].formatted == (r"[INST] <\/s>[\INST] ok [\/INST] [/INST]" r"<s> <\/s>[\INST] ok [\/INST] </s>")
    assert [tuple(s) for s in got[-1].loss_spans] == [(43, 24)]


def test_odd_rows(spark):
    long = "word </s> " * 50_000
    check(spark, [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "x"), (2, 5, "assistant", ""),
                  (None, 1, "assistant", "y"), (3, 1, "assistant", long), (3, 1, "user", long), (4, 0, "assistant", "</s>")])
    none = spark.createDataFrame([], SCHEMA)
    assert chat.conversations(none).count() == 0


def test_long_conversation(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"text {k} </s>") for k in range(3000)]
    check(spark, rows)
    assert chat.conversations(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)).select(
        F.size("loss_spans")).first()[0] == 1500
