"""Round trips of typed parts: placeholders and texts that spell them, ties, repeated turns, odd types, clashing names."""

from pyspark.sql import functions as F

from vellum.llm import chat

SCHEMA = f"conv_id long, turn long, role string, content array<{chat.PART}>"


def text(x):
    return ("text", x, None, None, None, None, None)


def image(width=28, height=15):
    return ("image", None, "i.png", width, height, None, None)


def test_placeholders_are_not_texts(spark):
    long = "<|image:0|>[x]\\<" * 40_000
    rows = [
        (1, 0, "user", [image()]), (1, 1, "user", [text("<|image:0|>")]), (1, 2, "assistant", [text("a"), image(), text("<|end|><|turn|>"), text("b")]), (1, 3, "assistant", [text(long)]),
        (2, None, None, [("we|rd:1|>", None, "u", None, None, None, None), None, (None, "typeless", None, None, None, None, None)]), (2, 0, "user", None), (2, 0, "user", []),
        (3, 1, "b", [text("same")]), (3, 1, "a", [text("2")]), (3, 1, "b", [text("same")]), (3, 1, "a", [text("1")]), (3, 1, "a", [("audio", None, "s", None, None, None, None), ("document", None, "d", None, None, None, None)]),
    ]
    turns = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("flat", "attached", "piece", "start", "rows", "row", "loss", "formatted")})
    done = chat.conversations(turns)
    got = {r.conv_id: r for r in done.select("*", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("said")).collect()}
    parts = lambda c: [[tuple(p) for p in t.parts] for t in got[c].turns]
    assert parts(1) == [[("image", None, 0)], [("text", "<|image:0|>", None)], [("text", "a", None), ("image", None, 1), ("text", "<|end|><|turn|>b", None)], [("text", long, None)]]
    assert [t.text for t in got[1].turns] == ["", "<|image:0|>", "a<|end|><|turn|>b", long] and got[1].said == "a<|end|><|turn|>b" + long
    assert [(a.turn, a.part, a.type, a.tokens) for a in got[1].attachments] == [(0, 0, "image", 4), (2, 1, "image", 4)]
    assert parts(2) == [[("other", None, 0), ("text", "typeless", None)], [], []] and [a.type for a in got[2].attachments] == ["we|rd:1|>"]
    assert [(t.role, t.text) for t in got[3].turns] == [("a", "1"), ("a", "2"), ("a", ""), ("b", "same"), ("b", "same")] and [a.tokens for a in got[3].attachments] == [0, 256]
    assert chat.conversations(turns.limit(0)).count() == 0


def test_a_type_with_a_line_end_is_no_name_of_a_placeholder(spark):
    rows = [(1, 0, "assistant", [text("a"), ("image\n", None, "u", 20, 20, None, None), text("b")])]
    done = chat.conversations(spark.createDataFrame(rows, SCHEMA))
    got = done.select(chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("said")).first()
    assert [tuple(p) for p in got.turns[0].parts] == [("text", "a", None), ("other", None, 1), ("text", "b", None)] and got.said == "ab"
