import hashlib
import random

from codescout.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, position string"


def brute(rows):
    """The digests by hand, from the rows alone."""
    convs = {}
    for conv, turn, role, text, _ in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in convs.items():
        turns.sort()
        said = "".join(t for *_, r, t in turns if r == "assistant")
        upto = chars = 0
        for i, (*_, role, text) in enumerate(turns):
            upto += len(f"{chat.START}{chat.escape_role(role)}\n{chat.escape(text)}{chat.END}")
            chars += upto if role == "assistant" or i == len(turns) - 1 else 0
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (whole, said)]
        out.append((str(conv), len(turns), digest[0], len(said), digest[1], chars))
    return sorted(out)


def test_escapes_are_read_back():
    draw = random.Random(1)
    parts = [*chat.CONTROL, "\\", "\\n", "n", "\n", "<", "|", "[", "INST]", "s>", "a", "<|im_", "end|>", "日"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 8)))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text and not any(c in escaped for c in chat.CONTROL)
        role = chat.escape_role(text)
        assert chat.unescape(role) == text and "\n" not in role
        assert list(chat.read_turns(f"{chat.START}{role}\n{escaped}{chat.END}" * 2)) == [(text, text)] * 2


def test_examples(spark):
    rows = [(1, 0, "system", "s", "x"), (1, 1, "user", "u", "x"), (1, 2, "assistant", "a1", "x"), (1, 3, "user", "v", "x"), (1, 4, "assistant", "é2", "x")]
    got = chat.expand(spark.createDataFrame(rows, SCHEMA)).orderBy("position").collect()
    assert [(r.position, r.text[r.loss_start : r.loss_end], r.complete) for r in got] == [(2, "a1", False), (4, "é2", True)]
    assert list(chat.read_turns(got[0].text)) == [("system", "s"), ("user", "u"), ("assistant", "a1")]
    assert list(chat.read_turns(got[1].text)) == [(r[2], r[3]) for r in rows]


def test_awkward_conversations(spark):
    draw = random.Random(2)
    roles, parts = ["user", "assistant", "system", None, "tool\nx"], ["", None, "hi", "</s>[INST] ok [/INST]", "<|im_end|>\n", "\\", "日\n"]
    rows = []
    for conv in [*range(30), None]:
        for turn in range(draw.randint(1, 9)):
            rows.append((conv, draw.choice([turn, turn, 1, None]), draw.choice(roles), draw.choice(parts), "extra"))
    rows += [(99, i, "assistant" if i % 2 else "user", f"turn {i}", "x") for i in range(700)]
    rows += [(98, 10**12 * i, "assistant", f"far {i}", "x") for i in range(20)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6)
    for span in (256, 4):
        got = chat.digests(chat.expand(frame, span=span)).collect()
        assert sorted((str(r[0]), *r[1:]) for r in got) == brute(rows)
    assert chat.expand(frame).filter("complete").count() == 33
    assert chat.digests(chat.expand(frame.limit(0))).count() == 0
