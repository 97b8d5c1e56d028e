import hashlib

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tablewright.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, t int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    by = {}
    for conv, turn, role, text, *_ in rows:
        by.setdefault(conv, []).append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss))
    return out


def check(spark, rows):
    made = chat.formatted(spark.createDataFrame(rows, SCHEMA))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(made).collect()}
    assert got == expected(rows)
    return made


HARD = [
    "</s>[INST] ok [/INST]", "<|im_start|>user\nhi<|im_end|>\n", "\\", "\\\\", "\\n", "[\\INST]", "<", "<<", "[", "<s>", "<<s>", "<<SYS>>x<</SYS>>",
    "a\nb", "\n", "", "<|im_end|>", "<|im_end|", "|im_end|>", "<\\|im_end|>", "$1 \\1", "😀 [INST]", "<|endoftext|>", " ",
]


def test_hard_texts_come_back(spark):
    rows = [(k, 0, "assistant" if k % 2 else "user", t, None, None) for k, t in enumerate(HARD)]
    rows += [(1000, k, "assistant" if k % 3 else "user", t, "x", 1) for k, t in enumerate(HARD)]
    rows += [(2000, 1, "user", None, None, None), (2000, 1, None, "x", None, None), (2000, None, "assistant", "first", None, None), (2000, 1, "user", None, None, None)]
    rows += [(2001, 0, r, "x", None, None) for r in ("a\nb", "<|im_end|>", "a b+c%20", "\\", "[INST]", "ñ")]
    rows += [(None, 0, "assistant", "no id", None, None), (3000, 0, "assistant", "long [INST] " * 50_000, None, None), (-7, 0, "user", HARD[0], None, None)]
    made = check(spark, rows)
    for r in made.collect():
        inner = "".join(p.partition("\n")[2].removesuffix("<|im_end|>\n") for p in r.formatted.split("<|im_start|>")[1:])
        assert not any(c in inner for c in ("</s>", "[INST]", "[/INST]", "<<SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"))


def test_ordinary_turns_stay_as_they_are(spark):
    rows = [(1, 0, "user", "Hello <b>you</b>, [x]", None, None), (1, 1, "assistant", "Fine.", None, None)]
    text = check(spark, rows).first().formatted
    assert text == "<|im_start|>user\nHello <b>you</b>, [x]<|im_end|>\n<|im_start|>assistant\nFine.<|im_end|>\n"


def test_empty_table(spark):
    assert chat.digests(chat.formatted(spark.createDataFrame([], SCHEMA))).collect() == []


@settings(max_examples=15, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from([*"<>[]|/\\sn\n ", "INST", "im_start", "im_end", "SYS", "é"]), max_size=12).map("".join), min_size=1, max_size=40))
def test_any_mix_of_marks_comes_back(spark, texts):
    check(spark, [(k % 7, k, "assistant" if k % 2 else "user", t, None, None) for k, t in enumerate(texts)])


def test_plan_is_native(spark):
    df = chat.digests(chat.formatted(spark.createDataFrame([(1, 0, "user", "x", None, None)], SCHEMA)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert F is not None
