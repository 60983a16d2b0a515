import hashlib
import random

from sightline.llm import chat

NASTY = ["", "\\", "\\~", "\\\\~", "~", "<|im_end|>\n", "<|im_start|>user\nx<|im_end|>\n", "</s>[INST] ok [/INST]", "<<SYS>> a <</SYS>>", "a\nb", "\\%", "<", "<|", "[/INST", "<\\|im_end|>", "é日本🙂", " x ", "<|im_end|>", "\n", "<<s>>"]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(data):
    convs = {}
    for k, (conv, turn, role, text) in enumerate(data):
        convs.setdefault(("row", k) if conv is None else conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in convs.items():
        turns.sort(key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))
        loss = "".join(t[3] for t in turns if t[2] == "assistant")
        out.append((None if isinstance(conv, tuple) else conv, len(turns), digest("".join(f"{t[2]}\n{t[3]}\n" for t in turns)), len(loss), digest(loss)))
    return sorted(out, key=str)


def run(spark, data):
    return chat.format_chat(spark.createDataFrame([(*r, 5, "z") for r in data], "conv_id long, turn long, role string, text string, size int, piece string").repartition(3))


def test_round_trip_of_conflicting_content(spark):
    rng = random.Random(3)
    data = []
    for conv in range(80):
        for turn in range(rng.randrange(1, 6)):
            role = rng.choice(["user", "assistant", "system", None, "odd\nrole", "x\\", "assistant"])
            data.append((conv, turn, role, rng.choice([None, "".join(rng.choice(NASTY) for _ in range(rng.randrange(4)))])))
    data += [(None, 0, "user", "a"), (None, None, "assistant", "b"), (500, 1, "user", "tie"), (500, 1, "user", "tie"), (500, 1, "assistant", "tie"), (501, 0, "assistant", "w " * 50000)]
    formatted = run(spark, data)
    read = chat.read_back(formatted).collect()
    assert sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in read), key=str) == brute(data)
    assert all(r.intact for r in read)
    for r in formatted.collect():
        inside = r.rendered.replace("<|im_start|>", "\0").replace("<|im_end|>", "\1")
        assert inside.count("\0") == inside.count("\1") > 0
        assert "[INST]" not in r.rendered and "</s>" not in r.rendered


def test_empty_table(spark):
    assert run(spark, []).count() == 0


def test_turns_are_counted_in_the_output(spark):
    """A rendering that lost a turn shows it."""
    from pyspark.sql import functions as F

    formatted = run(spark, [(1, 0, "user", "a"), (1, 1, "assistant", "b")])
    cut = formatted.withColumn("rendered", F.expr("substring(rendered, 1, instr(rendered, '<|im_end|>') + 10)"))
    assert [r.n_turns for r in chat.read_back(cut).collect()] == [1]
